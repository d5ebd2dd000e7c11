"""Spark-first analytics over scored rollouts, scene frames and training corpora."""

__version__ = "0.1.0"
