"""Operations of a training-data pipeline: filters, deduplication, mixing, tokenizing and extraction."""
