"""The cleaning steps over files as they arrive."""
