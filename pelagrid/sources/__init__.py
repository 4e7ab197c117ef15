"""Where cubes come from and where they are kept."""
