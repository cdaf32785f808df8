"""Single-statement tools: parsing, facts, fingerprints, lineage, rewrites, decomposition."""
