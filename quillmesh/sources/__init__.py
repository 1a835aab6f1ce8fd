"""Pages and other resources as DataFrames, and the one Python stage that parses HTML."""
