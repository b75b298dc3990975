"""Spark-first retrieval and analytics over large collections of session transcripts."""
