"""Operators for large-scale training-data preparation. Nothing else in folio imports this subpackage."""
