"""structura: a PySpark-native market-structure analytics engine."""

__version__ = "0.1.0"
