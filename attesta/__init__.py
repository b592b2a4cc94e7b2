"""Attesta: evidence analysis over text collections, expressed with Spark DataFrames."""
