"""DataFrame operators: reports, group consistency, joins, generators, ordered analytics, statistics."""
