"""Training-data operators: classifiers, near duplicates, decontamination, archives, mixing, token files, sharding.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
