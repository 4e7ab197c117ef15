"""Operators on cubes, composed from DataFrame expressions."""
