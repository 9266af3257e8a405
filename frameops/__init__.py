"""Relational operators, declarative plans and result judging on Spark DataFrames."""
