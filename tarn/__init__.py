"""tarn: descriptor analytics as composable Spark DataFrame operators."""
