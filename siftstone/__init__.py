"""Spark-native content security analytics."""
