"""Column expressions: text, addresses, dates, classes and scores."""
