"""Training-data operators: classifiers, near-duplicate search, tokenizers, audits.

Nothing outside this folder imports it.
"""
