"""Corpus-wide checks of linked credential documents, declared as Spark DataFrames."""
