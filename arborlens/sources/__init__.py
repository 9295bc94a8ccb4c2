"""Readers and writers: file trees, ignore files, cache versions, reports."""
