"""Part of the listing engine."""
