"""cairnlake: map-like datasets, merges, grids, networks and quality rules as Spark DataFrame operators."""
