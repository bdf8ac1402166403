"""Named queries over the test tables, and their SQL."""

#: Modules with QUERIES (name to function of session and folder) and SQL (name to text).
MODULES = ("problems", "clouds", "city", "more", "shapes", "models", "formats")
