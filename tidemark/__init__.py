"""Tidemark: ordered, versioned key/value data on PySpark."""
