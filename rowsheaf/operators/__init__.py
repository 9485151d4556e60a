"""The operators: merge, split, extract, profile, sample values, event metrics, counters."""
