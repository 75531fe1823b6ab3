"""Change-intelligence analytics on PySpark: composable DataFrame operators."""
