"""A PySpark-native engine for web-page graphs: URL algebra, link extraction, Markdown conversion and cleaning, traversal."""
