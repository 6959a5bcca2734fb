"""Analytics jobs written as DataFrame transformations."""
