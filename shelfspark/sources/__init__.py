"""Readers and writers: catalog payloads, probes, sidecars, containers, trees, tables."""
