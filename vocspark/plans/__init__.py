"""Complete flows made of operators: collect, filtered view, sync."""
