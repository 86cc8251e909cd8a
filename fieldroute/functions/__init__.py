"""functions of the fieldroute engine."""
