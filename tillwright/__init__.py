"""Receipt analytics as composable Spark DataFrame operators."""
