"""Structured Streaming versions of the stateless steps, and packing of arriving rows."""

from corpusloom.streaming.pack import pack_stream
from corpusloom.streaming.read import read_stream, run_available

__all__ = ["pack_stream", "read_stream", "run_available"]
