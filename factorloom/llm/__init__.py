"""Operators for preparing training text: formatting, scoring, deduplication, mixing, packing and scans."""
