"""updraft: streak and volume-anomaly screening of price bars on PySpark."""

from updraft.config import ScreenConfig
from updraft.plans.screening import published_screen, screen

__all__ = ["ScreenConfig", "published_screen", "screen"]
