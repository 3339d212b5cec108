"""Security-event analytics as DataFrame-to-DataFrame functions."""

from watchframe.session import session

__all__ = ["session"]
