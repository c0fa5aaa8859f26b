"""Operators for preparing large text corpora, each run as Spark jobs."""
