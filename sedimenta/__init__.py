"""Event-log analytics on Spark: a typed pipe language over versioned, segmented event sources."""
