"""Training-data operators: token counts, near-duplicate detection, web archives,
packing, BPE, quality rules, fingerprints, URL filters, secret scans and line
dedup. Nothing outside this package imports it."""
