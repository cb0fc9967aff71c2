"""strataform: document structuring and catalogue queries as Spark DataFrame plans."""
