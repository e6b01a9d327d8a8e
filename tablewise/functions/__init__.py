"""Column functions: text, dates, numbers and JSON."""
