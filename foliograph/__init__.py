"""Document and graph analytics expressed as Spark DataFrame programs."""
