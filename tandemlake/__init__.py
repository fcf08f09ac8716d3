"""Spark-native interval, repeat-array and sequence-similarity analytics."""
