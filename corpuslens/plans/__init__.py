"""From query strings to predicates and plans."""
