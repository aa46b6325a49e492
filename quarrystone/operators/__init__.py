"""Relational operators over uploads, refs, pages, entries, cells and session events."""
