"""Source-scan, policy and audit analytics as PySpark DataFrame operators."""
