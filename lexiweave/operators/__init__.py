"""DataFrame operators over texts and lexicons."""
