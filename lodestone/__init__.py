"""Lodestone: evidence-anchored document analytics expressed as PySpark plans."""
