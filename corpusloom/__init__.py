"""Corpus preparation for language-model work, written as Spark jobs."""

from corpusloom.session import cut_lineage, local_session, scratch_path, ship_package

__all__ = ["cut_lineage", "local_session", "scratch_path", "ship_package"]
