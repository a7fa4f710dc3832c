"""Column expressions: cleaning, billing codes and predicates."""
