"""Training-data pipeline operators.

Nothing else in the package imports this subpackage; it imports nothing from
the rest of the package either, so either side can be removed alone.
"""
