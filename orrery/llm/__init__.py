"""Operations of a training-data pipeline: counting, scoring, deduplication, search, tokenization.

Nothing outside this folder imports it (``__spark_entry__`` does so behind a guard).
"""
