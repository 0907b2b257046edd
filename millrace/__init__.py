"""Composable event-data blocks on Spark DataFrames."""
