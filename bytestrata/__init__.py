"""Structure analytics over byte blobs, expressed as Spark DataFrame transformations."""
