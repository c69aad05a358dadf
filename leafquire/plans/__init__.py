"""Whole jobs: corpus build, index build, batch search."""
