"""Column expressions. All are row-local, so they also work on a stream."""
