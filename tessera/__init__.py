"""Tessera: analytics operators, sources and a script layer on PySpark."""
