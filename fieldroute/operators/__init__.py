"""operators of the fieldroute engine."""
