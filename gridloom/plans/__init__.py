"""Plans: network summaries and the registered queries."""
