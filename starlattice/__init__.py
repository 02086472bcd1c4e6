"""A sky-data and corpus analytics engine on Spark."""
