"""Catalogued queries, one module per operator area."""
