"""Training-data operators: scoring, decontamination, search, licences, PII,
toxicity, mixing, near duplicates, repeated substrings and web archives."""
