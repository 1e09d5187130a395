"""Training-data operators: packing, URL rules, quality scores, secret scans, tokenizers, similarity joins, shards and fingerprints."""
