"""Readers and writers of notes and link tables."""
