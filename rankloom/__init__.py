"""Ranking analytics over impression logs, written as Spark DataFrame plans."""
