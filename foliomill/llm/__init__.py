"""Training-data operators: scoring, sharding, dedup, decontamination, packing and friends.

Nothing outside this subpackage imports it.
"""
