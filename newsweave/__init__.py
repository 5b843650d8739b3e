"""newsweave: media-coverage analytics over large document collections, on Spark DataFrames."""

__version__ = "0.1.0"
