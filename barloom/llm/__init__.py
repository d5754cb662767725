"""Operators for training-data corpora: personal data, near-duplicates, decontamination, quality, secrets, token files, mixing, licences, lines, urls."""
