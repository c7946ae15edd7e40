"""Expression functions over cells."""
