"""Tessera: code and dependency analytics expressed as Spark DataFrame plans."""
