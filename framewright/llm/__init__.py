"""Training-data pipeline operators: deduplication, search, filtering, mixing."""
