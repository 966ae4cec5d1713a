"""Customs-declaration analytics as Spark DataFrame jobs."""
