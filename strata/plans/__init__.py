"""Plans: silver transforms, gold star schema, reports, checks and analyses."""
