"""Plan helpers: tables, shared folder, lineage cuts."""
