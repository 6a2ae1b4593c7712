"""siltstone: incremental ingestion of recordings and texts, and the analytics around it, on Spark."""
