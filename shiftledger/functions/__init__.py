"""Column functions: text, dates, measures, roles."""
