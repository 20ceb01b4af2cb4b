"""Column functions and the one parser that needs Python."""
