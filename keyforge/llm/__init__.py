"""Training-data operators: licence scans, page text, byte-level BPE, secret
scans, quality scoring and rules, source mixing, vector search, sharding and
near-duplicate removal.  Nothing else in the library imports this package."""
