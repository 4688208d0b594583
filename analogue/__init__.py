"""The domain's tables derived from the given star schema, and matching SQL."""
