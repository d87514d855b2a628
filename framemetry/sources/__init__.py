"""Readers and writers: picture folders, result tables, run logs, text scans."""
