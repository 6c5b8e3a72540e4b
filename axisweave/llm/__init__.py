"""Training-data operators (sharding, fingerprints, tokenising, decontamination, dedup, classifiers, archives).

Nothing else in the library imports this subpackage; ``queries.py`` registers its queries.
"""
