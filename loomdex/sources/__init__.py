"""Readers of file trees, version-control output and other inputs."""
