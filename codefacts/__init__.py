"""Facts about bodies of source code and text, as Spark DataFrames."""

__version__ = "0.1.0"
