"""Dataset curation as Spark DataFrame transformations."""
