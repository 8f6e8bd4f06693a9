"""Training-data operators: search, packing, scans, extraction, deduplication, decontamination and scoring."""
