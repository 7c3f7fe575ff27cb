"""Millrace: plant-record and historian analytics as Spark DataFrame jobs."""
