"""Column expressions and scalar helpers shared by sources and operators."""
