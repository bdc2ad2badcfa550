"""symbolmill: code-retrieval analytics as Spark DataFrame plans."""
