"""Column functions: scalar expressions, aggregates and declared types."""
