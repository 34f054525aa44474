"""Two-group text and entity analytics expressed as PySpark plans."""
