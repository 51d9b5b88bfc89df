"""Part of quernstone."""
