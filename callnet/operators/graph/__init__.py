"""Graph operators over vertices(node) and edges(source, target, ...)."""
