"""waybill: a PySpark-native engine for reconciling and cleaning business-document records."""

__version__ = "0.1.0"
