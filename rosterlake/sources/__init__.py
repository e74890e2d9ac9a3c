"""Readers and writers: file drops, landed API payloads, layer exports."""
