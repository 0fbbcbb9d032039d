"""Incident analytics over service logs, written as DataFrame -> DataFrame functions keyed by ``log_id``."""

from faultline.config import Settings

__all__ = ["Settings"]
