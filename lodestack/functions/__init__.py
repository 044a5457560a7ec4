"""Column builders: expressions over columns that Catalyst compiles."""
