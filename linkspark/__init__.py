"""PySpark-native link analytics and general data-processing operators."""

__version__ = "0.1.0"
