"""Relational operators: skew-safe joins, ranking, stored-table changes, layout, relevance."""
