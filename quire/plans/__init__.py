from quire.plans import queries, reports  # noqa: F401  (the second adds to the first's registry)
