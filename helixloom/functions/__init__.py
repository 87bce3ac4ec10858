"""Part of helixloom."""
