"""Registered queries; importing this package fills ``registry``."""

from . import evaluation, io, rasters, selection, splits  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
