"""Operators of a training-data pipeline: de-duplication, filters, scoring, packing and file formats."""
