"""Training-data operators: token files, chat windows, BPE, decontamination, near-duplicates, sharding, toxicity."""
