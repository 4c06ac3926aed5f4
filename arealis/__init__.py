"""Small-area analytics as composable PySpark DataFrame operators."""
