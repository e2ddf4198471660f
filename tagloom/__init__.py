"""Tagloom: curation of image-and-caption datasets as Spark DataFrame jobs."""

__version__ = "0.1.0"
