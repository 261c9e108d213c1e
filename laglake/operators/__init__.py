"""DataFrame -> DataFrame operators (joins, grouping, windows, shuffles)."""
