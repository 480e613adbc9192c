"""Importing this registers all components."""

from corpusflow.operators import aggregations, basic, dedup, formats, gopher, lengths, markup, models, ocr, pii
from corpusflow.sources import readers, writers

__all__ = ["aggregations", "basic", "dedup", "formats", "gopher", "lengths", "markup", "models", "ocr", "pii", "readers", "writers"]
