"""Mortise: a deductive analytics engine on PySpark DataFrames."""
