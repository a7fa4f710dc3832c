"""Writers for plans, rates, charges and the relational star."""
