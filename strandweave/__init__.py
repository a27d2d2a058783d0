"""Contact-map scaffolding and training-data operations as Spark DataFrame plans."""
