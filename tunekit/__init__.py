"""Preparation, training and hyper-parameter search for binary classifiers on Spark."""

__version__ = "0.1.0"
