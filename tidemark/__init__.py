"""Engagement-cascade analytics written as Spark DataFrame jobs."""
