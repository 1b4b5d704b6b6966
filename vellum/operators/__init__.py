"""Operators over the note index, the link tables and note texts."""
