"""End-to-end plans built from the operators: feature tables, model families, canonical views."""
