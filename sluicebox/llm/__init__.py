"""Operators for training-data corpora: secrets, sharding, packing, decontamination,
transport streams, toxicity, line and near-duplicate removal, web archives, token counts."""
