"""What a request means, before anything is read: projections, windows, predicates."""
