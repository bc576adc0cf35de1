"""Document-screening analytics expressed as Spark DataFrame transformations."""
