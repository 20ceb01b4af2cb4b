"""The checks, by category, and the relational operators that they share."""
