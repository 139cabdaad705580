"""Wardwright: hospital operations analytics as Spark DataFrame operators."""
