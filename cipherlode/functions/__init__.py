"""Part of cipherlode."""
