"""roamlog: check-in history analytics as PySpark DataFrame operators."""
