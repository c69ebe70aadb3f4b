"""Operators of a training-data pipeline: quality, privacy, URL rules, tokens,
contamination, archives, near duplicates, repeats and licences."""
