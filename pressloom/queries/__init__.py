"""Every registered query: importing the modules registers them."""

from pressloom.queries import corpus, ingest, more, opinions, rankings, texts, topics  # noqa: F401
from pressloom.registry import ORACLES, QUERIES  # noqa: F401
