"""Column functions and small numeric functions."""
