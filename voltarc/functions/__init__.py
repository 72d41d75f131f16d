"""Column expressions, fixed values, and skew-safe ordered and quantile helpers."""
