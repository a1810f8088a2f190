"""Strata: retrieval, text governance and corpus analytics as DataFrame programs."""
