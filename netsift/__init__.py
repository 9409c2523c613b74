"""Network-threat analytics as PySpark DataFrame operators."""
