"""Daily market-bar analytics as plain DataFrame -> DataFrame functions on Spark."""
