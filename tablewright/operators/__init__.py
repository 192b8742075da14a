"""DataFrame to DataFrame operators, grouped by what they do."""
