"""DataFrame operators over form tables."""
