"""Event rules as Structured Streaming queries."""
