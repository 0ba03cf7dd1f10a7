"""Reading and writing tables, bound parameters, staged publishing."""
