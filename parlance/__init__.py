"""Spark-native analytics for corpora of learner texts."""
