"""Scholia: Spark-native analytics over document corpora and learner event logs."""
