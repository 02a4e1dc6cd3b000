"""Spark-native analysis of matches between short query sequences and targets."""
