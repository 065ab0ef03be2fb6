"""Lectern: text-corpus analytics as Spark DataFrame plans."""
