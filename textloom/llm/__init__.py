"""Training-data operators: scoring, decontamination, privacy, quality, de-duplication, tokens."""
