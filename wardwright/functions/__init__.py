"""Column functions: text, numbers, dates and distributed ordering."""
