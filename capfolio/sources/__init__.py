"""Readers that turn files or other tables into the four raw tables."""
