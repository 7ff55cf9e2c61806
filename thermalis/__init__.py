"""Thermal-source analytics on Spark: DataFrame operators, no engine of their own."""
