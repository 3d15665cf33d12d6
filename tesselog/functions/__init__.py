"""Part of tesselog."""
