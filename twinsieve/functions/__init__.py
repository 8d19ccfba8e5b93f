"""Functions of the near-duplicate engine."""
