"""waraq: page-structured document ingestion and phrase search as Spark DataFrame transformations."""
