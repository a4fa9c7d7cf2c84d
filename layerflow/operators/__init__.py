"""DataFrame operators, one module per family of steps."""
