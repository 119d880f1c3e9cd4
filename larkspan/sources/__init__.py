"""Where rows come from: Parquet folders, the versioned store, its columnar replica."""
