"""Training-data operators: mixing, chat formatting, near-duplicates, URL and quality filters, WARC, tokens, PII."""
