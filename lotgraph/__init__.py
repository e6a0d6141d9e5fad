"""Lot-level impact and cause analytics as Spark DataFrame plans."""
