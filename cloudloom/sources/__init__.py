"""Readers and writers: structure files, id lists, annotation tables, feature tables, reports."""
