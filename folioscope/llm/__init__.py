"""Training-data operators: deduplication, decontamination, classifiers, mixing, token files, chat formatting.

Nothing outside this subpackage imports it.
"""
