"""Stand-in views on the given tables and the registered queries with their SQL."""
