"""Lodestone: code and text search, knowledge graphs and corpus operators on PySpark."""
