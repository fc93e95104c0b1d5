"""panelspark: keyed panel analytics as composable Spark DataFrame operators."""
