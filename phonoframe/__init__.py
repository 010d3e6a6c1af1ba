"""Speech-exam analytics as composable PySpark DataFrame functions."""
