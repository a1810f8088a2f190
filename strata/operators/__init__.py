"""Operators over DataFrames: retrieval, governance, chunking, routing, content, evaluation, packaging."""
