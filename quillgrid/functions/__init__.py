"""Column functions: text rules, similarity, image kernels."""
