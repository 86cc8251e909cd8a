"""fieldroute: a Spark-first analytics engine for field-service operations."""
