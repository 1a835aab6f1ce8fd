"""Change detection over streams of pages."""
