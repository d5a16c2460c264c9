"""Column functions: geodesy, classes and display arithmetic."""
