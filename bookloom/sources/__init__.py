"""Sources of the order-book engine."""
