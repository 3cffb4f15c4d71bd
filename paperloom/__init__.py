"""Paperloom: DataFrame-native analytics over research-paper corpora."""
