"""Training-data operators: mixing, dedup, decontamination, sharding, scoring, formatting.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
