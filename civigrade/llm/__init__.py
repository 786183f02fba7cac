"""Operators for preparing training data: classifiers, deduplication, decontamination, mixing, sharding, extraction."""
