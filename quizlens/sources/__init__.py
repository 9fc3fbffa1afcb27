"""Readers and writers of the files that connect the stages."""
