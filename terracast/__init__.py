"""Localised forecast analytics as Spark DataFrame operators."""
