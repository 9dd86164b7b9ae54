"""Readers and writers: log directories, growing files, frame captures, text."""
