"""Templates, model output and extractors."""
