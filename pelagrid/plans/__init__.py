"""Composed analyses, and a look at the plans Spark makes of them."""
