"""Column functions: geometry, event taxonomy, scoring and wording."""
