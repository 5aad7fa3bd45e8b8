"""Readers and writers: format detection, extraction from files, JSON corpora, web pages, exports."""
