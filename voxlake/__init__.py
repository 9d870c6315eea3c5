"""voxlake: two-phase voxel analytics on Spark DataFrames."""
