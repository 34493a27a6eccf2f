"""Operations of a training-data pipeline over text and page tables."""
