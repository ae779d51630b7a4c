"""textloom: text retrieval and text analytics expressed as Spark DataFrame plans."""
