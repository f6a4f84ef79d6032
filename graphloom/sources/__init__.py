"""Graph files in and out."""
