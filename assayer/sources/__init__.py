"""Record files in, record files out."""
