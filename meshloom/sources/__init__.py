"""Sources and sinks of meshes: grids, Parquet folders, single-file formats, numpy arrays."""
