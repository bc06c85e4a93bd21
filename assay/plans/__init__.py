"""Jobs composed of several operators, and the query registry."""
