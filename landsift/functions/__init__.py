"""Column functions: text, geometry, rules, request log."""
