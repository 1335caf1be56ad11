"""Operators of a training-data pipeline over `documents` and `embeddings`.

One module for each operator, `opN_*.py`; `catalog.py` names their queries.
Nothing outside this folder and `corpus_pipeline.py` imports it.
"""
