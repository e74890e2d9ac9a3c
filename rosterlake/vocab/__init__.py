"""Fixed vocabularies, stated as plain values."""
