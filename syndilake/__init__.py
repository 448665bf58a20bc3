"""Analytics over web syndication feeds, and operators for training-data corpora, on Spark DataFrames."""

__version__ = "0.1.0"
