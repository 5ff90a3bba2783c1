"""Plans that combine operators: access methods by name, dense ids, the query catalogue."""
