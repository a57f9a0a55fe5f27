"""Readers: files, workbooks, HTML fields and a paged API."""
