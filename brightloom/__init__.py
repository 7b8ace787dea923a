"""brightloom: retrieval, deduplication and corpus analytics as Spark DataFrame programs."""
