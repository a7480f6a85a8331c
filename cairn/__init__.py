"""A retrieval and training-data engine on PySpark."""
