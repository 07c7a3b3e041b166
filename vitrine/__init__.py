"""vitrine: exploring Parquet tables and preparing text corpora on Spark."""
