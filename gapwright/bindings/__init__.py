"""The operators bound to the driver's synthetic tables, and the SQL they are
checked against."""
