"""gatehouse: a Spark-first engine for curating language-model training text."""

__version__ = "0.1.0"
