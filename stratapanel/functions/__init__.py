"""Column-level building blocks: null rules, text cleaning, metrics, name vocabulary."""
