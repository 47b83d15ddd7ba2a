"""Training-data operators: decontamination, exact search, archives, packing,
similarity joins, privacy, extraction and classifiers.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it is present.
"""
