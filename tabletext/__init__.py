"""tabletext: list tables to clean records and retrieval-ready text, on PySpark."""
