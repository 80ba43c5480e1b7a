"""Column expressions. Every function takes and returns ``Column`` objects and
stays inside the JVM (no Python UDF)."""
