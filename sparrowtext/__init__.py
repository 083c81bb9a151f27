"""Full-text search, relevance analytics and corpus processing as Spark plans."""
