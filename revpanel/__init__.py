"""Panels of time series and the revision history of panels, on Spark."""

from revpanel.functions.time import INF, PanelError, guess_period
from revpanel.log import RevisionLog
from revpanel.meta import LogMeta, PanelMeta
from revpanel.panel import Panel

__all__ = ["INF", "LogMeta", "Panel", "PanelError", "PanelMeta", "RevisionLog", "guess_period"]
