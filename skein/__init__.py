"""skein: retrieval analytics and training-data preparation as PySpark DataFrame operators."""

__version__ = "0.1.0"
