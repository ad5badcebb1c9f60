"""Indexed Parquet tables and their query layer for PySpark."""
