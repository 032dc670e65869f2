"""Set-at-a-time package-risk analytics on Spark: feeds, queues, source files, alerts and evidence as DataFrames."""

__version__ = "0.1.0"
