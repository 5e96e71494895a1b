"""sources of webloom."""
