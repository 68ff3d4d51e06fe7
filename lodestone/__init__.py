"""Retrieval evaluation and corpus analytics as Spark plans."""
