"""Spark-native matching of funding opportunities: clean, grade, de-duplicate, score, report."""
