"""Column expressions over series."""
