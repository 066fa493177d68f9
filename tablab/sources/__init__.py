"""Sources and sinks: Parquet tables, delimited text, fitted models."""
