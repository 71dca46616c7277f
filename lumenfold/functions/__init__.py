"""Column functions: text, hashing, buckets, vectors, probabilities."""
