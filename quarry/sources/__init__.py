"""Readers: driver tables, file trees, JSON documents and the derived corpora."""
