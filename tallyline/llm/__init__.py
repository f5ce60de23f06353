"""Operators for preparing training text: sharding, packing, filtering, deduplication, decontamination and encoding."""
