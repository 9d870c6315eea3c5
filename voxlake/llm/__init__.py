"""Operators for preparing training data: packing, near-duplicate search, classifiers, tokenizers, extraction, vector search.

Nothing else in voxlake imports this subpackage.
"""
