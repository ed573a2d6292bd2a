"""Column functions: geometry, text and unit conversions."""
