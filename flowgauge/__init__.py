"""flowgauge: set-at-a-time analytics over the state of data pipelines, on Spark DataFrames."""

__version__ = "0.1.0"
