"""Training-data operators; nothing else in tensorloom imports this subpackage."""
