"""Operators that prepare training text: mixing, fingerprints, classifiers, dedup, secrets, encoding, sharding."""
