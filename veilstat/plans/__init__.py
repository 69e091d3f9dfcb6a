"""Planning that needs no data: hierarchies, queries, user groups; and the query catalog."""
