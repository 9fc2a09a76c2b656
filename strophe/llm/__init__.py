"""Training-data operators: quality, extraction, toxicity, deduplication, tokens, urls, licences, leaks."""
