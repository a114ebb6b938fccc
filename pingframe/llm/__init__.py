"""Training-data operators: near-duplicates, quality, secrets, shards, neighbours, licences, leaks, mixing, language, lines."""
