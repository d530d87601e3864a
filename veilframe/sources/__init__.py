"""Readers, writers and parameter stores."""
