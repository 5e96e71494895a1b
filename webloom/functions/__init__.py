"""functions of webloom."""
