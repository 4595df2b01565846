"""Repository and corpus intelligence as Spark DataFrame plans."""
