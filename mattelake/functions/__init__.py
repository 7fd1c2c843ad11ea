"""Column functions: text, numbers and rasters held as arrays."""
