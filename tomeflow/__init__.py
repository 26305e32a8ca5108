"""tomeflow: corpus, retrieval and learning-analytics jobs on Spark DataFrames."""

__version__ = "0.1.0"
