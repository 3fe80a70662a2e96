"""Column functions, row kernels and their SQL registration."""
