"""Operators for preparing training corpora: de-duplication, filtering, mixing, scoring, search."""
