"""Column expressions: text, dates, numbers, structured values."""
