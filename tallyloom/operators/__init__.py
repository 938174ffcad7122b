"""DataFrame operators: validation, numbering, mapping, conversion and deduplication."""
