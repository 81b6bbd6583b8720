"""DataFrame-level operators: columns, crosswalk, merge, roll-up, reshape, checks."""
