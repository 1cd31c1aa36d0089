"""Named queries over the test tables, with the same questions in SQL."""
