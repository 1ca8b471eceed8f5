"""Column-level building blocks: every helper here returns a Column."""
