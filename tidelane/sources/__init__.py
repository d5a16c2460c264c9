"""Sources and sinks: rasters, polygons, graphs, caches, points of interest."""
