"""textrel: relational analytics over text collections, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
