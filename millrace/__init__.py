"""millrace: training-corpus preparation, auditing and evaluation as Spark DataFrame plans."""

__version__ = "0.1.0"
