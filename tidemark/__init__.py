"""tidemark: evidence analytics expressed as Spark plans."""
