"""Sources of files, symbols and edges."""
