"""Column expressions over vectors, and array kernels for what expressions can't say."""
