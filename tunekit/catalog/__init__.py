"""Named queries over the test tables, each with SQL that another engine can run to check it."""
