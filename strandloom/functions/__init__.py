"""Column functions: sequences and headers, alignment measures, evidence scores."""
