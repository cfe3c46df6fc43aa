"""Analytics over versioned key-value data on Spark, and operators for training data."""
