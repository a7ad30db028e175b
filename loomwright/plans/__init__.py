"""Named queries over the tables, with their SQL twins."""
