"""Plans: the cleaning step, stand-in inputs and the registered queries."""
