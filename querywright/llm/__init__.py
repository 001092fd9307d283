"""Training-data operators: sharding, packing, fingerprints, similarity joins, token files,
vector search, mixing, repeated-passage removal and weakly supervised classifiers.

Nothing outside this subpackage imports it.
"""
