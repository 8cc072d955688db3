"""Stream operators, the text table, groups and dictionary encoding."""
