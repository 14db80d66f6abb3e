"""Summary tables, the questions asked of them, and which of them can run."""
