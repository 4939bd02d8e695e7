"""locushift: region scoring, interval analytics and nomination on Spark DataFrames."""

__version__ = "0.1.0"
