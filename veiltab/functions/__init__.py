"""Column expressions: hashed randomness, cleaning, special functions, scores."""
