"""Graph compilation, traversal, quality control, linear algebra and association."""
