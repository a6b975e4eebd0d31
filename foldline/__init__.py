"""Spark-native modelling analytics over tables, series, predictions and ledgers."""

from foldline.roles import Roles
from foldline.session import build_session, cut_lineage

__all__ = ["Roles", "build_session", "cut_lineage"]
