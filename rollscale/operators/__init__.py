"""DataFrame-to-DataFrame operators: screens, joins, aggregates, windows, comparisons."""
