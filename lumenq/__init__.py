"""lumenq: a PySpark-native engine for product analytics and error, performance and uptime telemetry."""
