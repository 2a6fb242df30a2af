"""Training-data operators: formatting, media, filtering, deduplication, redaction, mixing and packing."""
