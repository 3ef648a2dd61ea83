"""Column-level functions: text, JSON, dates, vectors, geometry."""
