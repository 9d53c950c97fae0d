"""Quernstone: curation, verification and auditing of model-training text on Spark DataFrames."""

__version__ = "0.1.0"
