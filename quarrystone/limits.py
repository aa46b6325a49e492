"""Limits of ingestion and reading; each is a parameter of the operator that keeps it."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    file_bytes: int = 25 << 20
    archive_bytes: int = 100 << 20
    decompressed_bytes: int = 256 << 20
    batch_files: int = 10
    batch_bytes: int = 50 << 20
    page_bytes: int = 256 << 10
    page_lines: int = 2000
    archive_entries: int = 10_000
    head_bytes: int = 4100
    zip_directory_bytes: int = 2 << 20
    mimetype_bytes: int = 128
    part_bytes: int = 8 << 20
    pdf_pages: int = 10


LIMITS = Limits()
