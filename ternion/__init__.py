"""Ternion: a Spark-first engine for querying and reasoning over RDF graphs."""
