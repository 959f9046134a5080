"""Column functions and array kernels."""
