"""Training-data operators: dedup, chat formatting, mixing, quality, packing, language, URLs, fingerprints."""
