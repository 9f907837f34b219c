"""Query algebra, keys, normal forms, and the planner that reuses results under a page budget."""
