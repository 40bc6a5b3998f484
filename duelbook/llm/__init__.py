"""Operations of a training-data pipeline over documents, pages, conversations and embeddings.

Nothing outside this package imports it; ``__spark_entry__.py`` registers its queries when it is there.
"""
