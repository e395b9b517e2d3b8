"""Time-series analytics on Spark: conflict-free series, bucketed reads, compaction."""
