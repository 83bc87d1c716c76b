"""lamella: layered, key-sorted binary tables on Spark DataFrames."""

__version__ = "0.1.0"
