"""Readers and writers: files, graphs, feature bundles and the analysis store."""
