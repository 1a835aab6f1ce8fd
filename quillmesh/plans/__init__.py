"""Whole pipelines: read, graph, diff, robots and sitemaps, with their options."""
