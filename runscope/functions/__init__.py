"""Column expressions and scale-safe DataFrame helpers shared by the operators."""
