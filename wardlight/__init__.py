"""Spark-native classification of captured web pages, with operators for training data in a subpackage."""
