"""Readers, input contracts and derived inputs."""
