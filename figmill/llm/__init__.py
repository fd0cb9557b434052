"""Operators for training data: splits, caps, mixes, top-N, cutoffs, encoding, packing and spam pages."""
