"""Training-data operators: licence scan, WARC, dedup, toxicity, BPE and more."""
