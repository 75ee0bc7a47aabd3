"""passagemill: document preparation, guarded retrieval and evaluation as Spark DataFrame operators."""

__version__ = "0.1.0"
