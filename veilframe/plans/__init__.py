"""Ready-made queries over the benchmark tables."""
