"""recordloom: record movement and normalisation as Spark DataFrame operators."""

__version__ = "0.1.0"
