"""plans of webloom."""
