"""Structured Streaming jobs."""

from tilework.streaming.jobs import *  # noqa: F401,F403
