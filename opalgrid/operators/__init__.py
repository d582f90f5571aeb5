"""Column profiles, cardinality estimates and a cost model of block access."""
