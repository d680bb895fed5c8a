"""Readers and writers: files and text columns to typed DataFrames and back."""
