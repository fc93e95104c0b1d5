"""Streams: the latest value of each entity, and windowed counts. An extension; batch operators don't need it."""

from .latest import *  # noqa: F403
