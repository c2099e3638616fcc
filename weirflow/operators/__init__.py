"""Verbs from table to table: filters and shapes, order, aggregates, series, HTML, fuzzy search."""
