"""Operations of a training-data pipeline: one module for each operator, queries in ``queries``.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
