"""DataFrame operators: range joins, binning, statistics, windows, graphs and structure analysis."""
