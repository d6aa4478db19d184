"""Plans: the fold and the store built on it."""
