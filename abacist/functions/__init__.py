"""Column expressions, distribution tails and small matrix helpers."""
