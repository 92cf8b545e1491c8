"""Query registry over the benchmark tables, with the matching check SQL."""
