"""Column builders: scalar functions over geometry, text and time."""
