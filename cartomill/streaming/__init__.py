"""Streaming front ends."""
