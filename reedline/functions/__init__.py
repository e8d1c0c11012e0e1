"""Part of the sequence analytics library."""
