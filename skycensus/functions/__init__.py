"""Column expressions: curves, photometry, sky geometry, image arrays."""
