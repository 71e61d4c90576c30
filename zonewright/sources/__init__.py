"""Reading and writing zones and lookup tables."""
