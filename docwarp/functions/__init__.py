"""Part of docwarp; see the README for the map of modules."""
