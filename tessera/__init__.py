"""Tessera: corpus and evaluation analytics as Spark DataFrames."""
