"""Table operators: digests, order, readiness, profiles, deltas, lineage, rules, scores."""
