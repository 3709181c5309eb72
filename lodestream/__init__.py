"""lodestream: tables, time series, interval sets, vectors and graphs on Spark."""
