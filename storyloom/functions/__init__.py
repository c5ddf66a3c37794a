"""Column functions over text, claims, verdicts and identifiers."""
