"""Seamline: find where a relational schema, or any entity graph, can be cut, with Spark DataFrames."""
