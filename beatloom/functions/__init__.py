"""Column functions: labels, numbers, text and loose JSON values."""
