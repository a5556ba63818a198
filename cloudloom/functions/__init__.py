"""Column-level functions: guards, grouped metrics, windows and labels."""
