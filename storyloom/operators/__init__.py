"""Relational operators: joins, aggregates, windows, top-k, sets and entity resolution."""
