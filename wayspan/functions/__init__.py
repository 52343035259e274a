"""Column expressions: text cleaning, geometry and bit masks."""
