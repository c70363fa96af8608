"""Plans of the order-book engine."""
