"""Registered queries with their SQL counterparts."""

from . import catalogue, imagery, jobs, surveys
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalogue", "imagery", "jobs", "surveys"]
