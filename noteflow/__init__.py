"""noteflow: evidence retrieval and corpus processing as Spark DataFrame plans."""
