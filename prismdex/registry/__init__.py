"""The registered queries over the test tables, and the same results as plain SQL."""
