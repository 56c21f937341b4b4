"""grovelake: versioned document trees, ranked retrieval and training-data operators as Spark plans."""
