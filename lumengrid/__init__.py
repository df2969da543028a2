"""Image and pixel analytics on Spark DataFrames."""

from lumengrid.frame import ImageFrame, plugin

__all__ = ["ImageFrame", "plugin"]
