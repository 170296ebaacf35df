"""Website-audit analytics on Spark."""
