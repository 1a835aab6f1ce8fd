"""quillmesh: Spark-native web-content analytics."""

__version__ = "0.1.0"
