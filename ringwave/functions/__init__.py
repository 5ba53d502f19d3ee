"""Column expressions and the few vectorised Arrow helpers."""
