"""quirework: a Spark-first engine for staged document processing."""
