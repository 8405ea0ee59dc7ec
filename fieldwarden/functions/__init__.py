"""Column functions: hashing, numbers, text, JSON values and token arrays."""
