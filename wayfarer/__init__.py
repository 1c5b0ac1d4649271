"""Transit network analytics as PySpark jobs."""
