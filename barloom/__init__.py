"""Bar-panel strategy evaluation as PySpark jobs."""

__version__ = "0.1.0"
