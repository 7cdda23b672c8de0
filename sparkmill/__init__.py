"""sparkmill: corpus engineering, retrieval and evaluation analytics as Spark plans."""
