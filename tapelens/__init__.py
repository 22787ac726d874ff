"""Point-in-time market measurement on Spark."""
