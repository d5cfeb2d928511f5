"""Column functions and small driver-side parsers."""
