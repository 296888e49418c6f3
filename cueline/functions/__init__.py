"""Column expressions: text, time codes, level and confidence coercion."""
