"""Operators for preparing training text: archives, extraction, filters, deduplication,
decontamination, scoring and packing.  Nothing else in the library imports this package."""
