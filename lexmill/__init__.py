"""lexmill: learning and applying subword vocabularies over text in Spark tables."""

__version__ = "0.1.0"
