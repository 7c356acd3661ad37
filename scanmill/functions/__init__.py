"""Column expressions: pure arithmetic that stays inside generated code."""
