"""Dependency analysis of statically linked builds as Spark jobs."""
