"""parlance: conversation safety, tagging and session analytics as Spark jobs."""

__version__ = "0.1.0"
