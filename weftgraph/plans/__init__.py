"""Query plans that the driver runs, with their SQL counterparts."""
