"""Column functions and Arrow functions over text."""
