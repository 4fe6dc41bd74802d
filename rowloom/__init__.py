"""rowloom: representation analytics over heterogeneous tables, on Spark DataFrames."""

__version__ = "0.1.0"
