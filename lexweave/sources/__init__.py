"""Sources: PDF files, pages of text, landing folders."""
