"""quire: Spark jobs over document collections."""
