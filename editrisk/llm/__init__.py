"""Training-data operators: filtering, deduplication, mixing, tokenising.

Each module holds one operator; ``queries`` registers one query per operator.
Nothing else in the library imports this subpackage.
"""
