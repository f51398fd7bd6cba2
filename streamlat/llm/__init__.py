"""Operations of a training-data pipeline: tokens, duplicates, contamination, quality."""
