"""Readers and writers: observations, measurements, layers, boundaries, files, exports."""
