"""Registered queries; importing the modules fills the registry."""

from tidewell.catalog import jobs, parsing, retrieval, scoring, texts, upkeep
from tidewell.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "jobs", "parsing", "retrieval", "scoring", "texts", "upkeep"]
