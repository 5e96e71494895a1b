"""streaming of webloom."""
