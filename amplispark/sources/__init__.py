"""Readers of files that assays and searches come in."""
