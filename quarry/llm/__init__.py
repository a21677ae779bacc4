"""Operators for preparing training corpora: deduplication, decontamination,
classification, mixing and token output.  Nothing else in the library imports
this subpackage."""
