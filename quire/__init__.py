"""quire: catalog, collection and similarity analytics as Spark jobs."""
