"""Views of the test tables and the registered queries."""
