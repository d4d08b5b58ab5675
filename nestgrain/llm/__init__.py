"""Corpus operators for training data: archives, duplicates, decontamination, scans, classifiers, packing."""
