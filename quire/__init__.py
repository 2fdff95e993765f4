"""quire: document quality analytics as Spark DataFrame plans."""
