"""Training-data operators: dedup, classifiers, formatting, mixing, token output."""
