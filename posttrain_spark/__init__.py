"""Spark-native data operators for language-model post-training."""
