"""Analytics queries over the relational star."""
