"""Readers and writers for the text, JSON, CSV and Parquet formats the operators consume."""
