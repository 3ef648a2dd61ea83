"""Catalogue search and analytics over metadata records, as Spark DataFrame plans."""
