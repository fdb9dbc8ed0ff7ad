"""Named queries over the test tables and, where SQL can say them, their SQL."""
