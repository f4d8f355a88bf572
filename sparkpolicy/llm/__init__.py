"""Training-data pipeline operators: fingerprints, scans, deduplication, packing and capture archives.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
