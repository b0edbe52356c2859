"""Training-data operators: near duplicates, language model, media, quality, search, tokens, packing, toxicity, shards, mix."""
