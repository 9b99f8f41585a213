"""Analytics over quarterly, geography-keyed transaction panels, written for Spark."""
