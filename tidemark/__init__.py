"""Timeline analytics on Spark: indexes, merges, segmentation, manifests and job state as DataFrame plans."""

__version__ = "0.1.0"
