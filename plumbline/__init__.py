"""Data-analysis toolkit of plain DataFrame functions for Spark."""
