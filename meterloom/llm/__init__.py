"""Operators for language-model training data: distinct identifiers, packing, leaked test items, wrong encodings."""
