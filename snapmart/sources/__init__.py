"""Reading and writing dated snapshot tables."""
