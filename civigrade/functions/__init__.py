"""Column expressions: text, numbers, periods, names and scores."""
