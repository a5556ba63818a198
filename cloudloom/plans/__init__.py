"""Feature configuration and the choice of strategy for what is asked."""
