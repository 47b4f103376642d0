"""Where findings come from."""
