"""Evidentia: evidence resolution, catalogue queries and text-corpus operators as Spark jobs."""
