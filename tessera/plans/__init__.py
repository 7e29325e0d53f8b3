"""Plan-level helpers: lineage cuts, distributed ranks, parallelism."""
