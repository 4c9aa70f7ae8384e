"""Readers and writers of frames, controls and messages."""
