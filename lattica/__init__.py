"""Self-similarity and compressibility analytics over byte matrices, on Spark."""
