"""Readers and writers: tables, CSV with declared types or provenance, JSON, atomic publication, checkpoints."""

from .tables import *  # noqa: F403
