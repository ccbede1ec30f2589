"""Graph operators: lookups, degrees, traversals, orders, forests, containers."""
