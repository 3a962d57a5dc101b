"""Named queries over the operators, each with the SQL that says the same."""
