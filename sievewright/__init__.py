"""Spark-native "find, group, decide once, apply everywhere" analytics over text and source-code corpora."""
