"""Operations of a training-data pipeline: scoring, deduplication, filtering, token output, search."""
