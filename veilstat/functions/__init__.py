"""Column expressions: derived randomness and mechanism formulas."""
