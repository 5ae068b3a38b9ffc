"""Column expressions: windows, scalars, normal distribution."""
