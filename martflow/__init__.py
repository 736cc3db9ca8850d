"""martflow: a PySpark-native dimensional-warehouse and analytics engine."""
