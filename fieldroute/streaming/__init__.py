"""streaming of the fieldroute engine."""
