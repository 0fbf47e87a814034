"""rookery: Spark-native retrieval analytics over code units, telemetry and snapshots."""

__version__ = "0.1.0"
