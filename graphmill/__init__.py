"""Code-graph analytics as PySpark DataFrame queries."""
