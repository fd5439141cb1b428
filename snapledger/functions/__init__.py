"""Column functions: fingerprints of content and tests on paths."""
