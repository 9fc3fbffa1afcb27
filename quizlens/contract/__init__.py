"""The checked queries over the given tables, and SQL that must agree with them."""
