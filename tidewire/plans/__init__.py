"""Plans: bindings to the test tables, end-to-end flows, query catalog."""
