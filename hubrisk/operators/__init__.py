"""Table-to-table operators, grouped by subject."""
