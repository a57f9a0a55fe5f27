"""Analytics over evidence-linked review data, expressed with Spark."""
