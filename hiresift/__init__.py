"""Candidate screening as Spark DataFrame transformations."""
