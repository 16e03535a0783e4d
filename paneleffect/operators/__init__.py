"""DataFrame-to-DataFrame operators, grouped by purpose."""
