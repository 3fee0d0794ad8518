"""The tables of nodeloom.sources.store, by the name that the corpus operators use."""

from nodeloom.sources.store import Scratch, drop, shared_dir  # noqa: F401
