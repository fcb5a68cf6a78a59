"""Column functions: no joins, no shuffles, usable in batch and streaming plans."""
