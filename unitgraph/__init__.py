"""Dependency-graph analysis over node and edge tables, as Spark jobs."""
