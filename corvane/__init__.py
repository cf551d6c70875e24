"""corvane: text, retrieval, graph and event analytics as Spark DataFrame plans."""
