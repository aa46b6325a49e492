"""Readers: office documents, books, rich text and PDF as rows of paragraphs, cells and pages."""
