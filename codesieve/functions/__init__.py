"""Column functions: text handling, span extraction, scalar mappings."""
