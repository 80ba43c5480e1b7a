"""Rows for the edge cases that every operator must handle."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc long, tag long, n int, size int, component long, block int"
WORDS = "the quick brown fox jumps over a lazy dog while seven small wizards make bread and nobody looks at them today".split()


def document(i, text, lang="en", source="s"):
    """A row whose extra columns have names that the operators use inside."""
    return (i, text, lang, source, None if text is None else len(text), 1, 2, 3, 4, 5, 6)


def edge_rows():
    """Nulls everywhere, empty and long texts, a repeated row, an id with two texts, several scripts."""
    line = "this is a line that many documents share, and it is long enough to count as one"
    long = " ".join(f"{w}{k % 997}" for k in range(2500) for w in WORDS)
    rows = [
        document(None, None, None, None),
        document(1, None),
        document(2, ""),
        document(3, " \t\n\x0b\f\r "),
        document(4, long, "en", "big"),
        document(5, "word " * 3000, None, "big"),
        document(6, "\n".join([line, "own line of six", line.upper() + " "]), "de", None),
        document(6, "another text under the same id\n" + line, "de", None),
        document(7, "\n".join(["a", "b", "", line, "é ü ß — 漢字   x", ""]), "fr", "s"),
        document(8, "x" * 20000, "fr", "s"),
        document(None, "a text without an id\n" + line, "en", "s"),
    ]
    rows += [document(20 + k, f"{' '.join(WORDS[k % 5:])} number {k}\n{line}", "en", f"s{k % 3}") for k in range(8)]
    rows += [rows[-1], document(40, rows[-1][1]), document(41, rows[-1][1])]
    return rows
