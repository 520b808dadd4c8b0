"""Evaluation analytics on Spark: scores, reports, interval and stream operators as DataFrame plans."""
