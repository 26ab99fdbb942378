"""waymill: a Spark-native engine for map, graph, route and telemetry analytics."""

__version__ = "0.1.0"
