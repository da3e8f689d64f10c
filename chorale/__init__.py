"""Music-catalogue and listening analytics as composable Spark DataFrame functions."""
