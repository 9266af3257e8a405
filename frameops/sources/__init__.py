"""Reading and writing tables, records and databases."""
