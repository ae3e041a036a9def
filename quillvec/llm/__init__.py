"""Training-data operators: packing, duplicates, language, sharding, privacy, quality, HTML, pieces."""
