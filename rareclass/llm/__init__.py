"""Training-data operators: deduplication, language and toxicity filters, mixing, packing, token files, search."""
