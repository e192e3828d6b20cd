"""Frames from lists, Arrow tables and files, and back."""
