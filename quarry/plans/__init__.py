"""Composed pipelines: index building and batch answering."""
