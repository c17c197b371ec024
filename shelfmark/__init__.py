"""Catalog reconciliation as Spark DataFrame plans."""
