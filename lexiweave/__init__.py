"""Dictionary-driven text conversion on Spark."""
