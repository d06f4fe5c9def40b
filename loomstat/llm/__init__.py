"""Training-data operators: filtering, deduplication, scoring, mixing and output of text corpora."""
