"""operators of webloom."""
