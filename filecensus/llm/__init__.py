"""Operations of a training-data pipeline over `documents`, `benchmark` and `embeddings`."""
