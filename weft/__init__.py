"""weft: corpus building, dataset audits and retrieval evaluation as Spark
DataFrame operators."""

__version__ = "0.1.0"
