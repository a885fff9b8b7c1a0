"""Named queries over a data folder, and the SQL they are checked against."""
