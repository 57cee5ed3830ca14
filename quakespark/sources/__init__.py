"""Readers and writers of catalogue tables, waveforms, volumes and metadata."""
