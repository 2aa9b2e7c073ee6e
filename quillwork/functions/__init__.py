"""Column expressions: text, roles, procedure, names, dates, statistics, strict JSON."""
