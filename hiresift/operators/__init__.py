"""Analytics over the recruiting tables."""
