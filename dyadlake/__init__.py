"""Set-based analytics over directed pair behaviour, written for Spark."""
