"""Training-data operators: language ID, toxicity, near-duplicates, mixing, packing and their kin.

Nothing else in the library imports this subpackage.
"""
