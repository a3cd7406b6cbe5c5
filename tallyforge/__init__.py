"""Cloud cost analytics expressed as Spark DataFrame operators."""
