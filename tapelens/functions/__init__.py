"""Column functions: clocks, prices and content ids."""
