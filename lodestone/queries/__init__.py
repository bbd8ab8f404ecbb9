"""Queries over the library's own operators, with the SQL they are checked against."""

from . import collating, features, files, metrics, molecules, more, reading, retrieval, streams, text, tokens, voxels  # noqa: F401
from ._registry import ORACLE_SQL, QUERIES  # noqa: F401
from .retrieval import flagship  # noqa: F401
