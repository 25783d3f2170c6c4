"""Registry, document and funding analytics expressed as Spark DataFrame plans."""
