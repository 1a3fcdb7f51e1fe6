"""The path model: which paths are likely to hold findings."""
