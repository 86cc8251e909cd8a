"""sources of the fieldroute engine."""
