"""Reading PDF bytes as tables."""
