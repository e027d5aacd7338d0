"""Operations of a training-data pipeline over the document, page and embedding tables."""
