"""Distance functions as Column expressions and as numpy kernels."""
