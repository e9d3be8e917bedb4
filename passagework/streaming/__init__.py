"""Online query feed."""
