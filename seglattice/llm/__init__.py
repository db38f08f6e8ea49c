"""Training-data operators: sharding, near-duplicates, tokens, quality, chat, URLs, toxicity, media, leaks."""
