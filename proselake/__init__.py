"""Prose-quality analytics on Spark: text kernels, document analyses, gates and lint plans over DataFrames."""

__version__ = "0.1.0"
