"""Column functions: time stamps, text, syllables."""
