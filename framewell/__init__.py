"""framewell: relational analysis of porous crystals on Spark DataFrames."""

__version__ = "0.1.0"
