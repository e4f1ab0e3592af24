"""Automatic analytics for one untyped table, written as Spark DataFrame jobs."""
