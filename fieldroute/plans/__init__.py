"""plans of the fieldroute engine."""
