"""Queries and SQL of the operators."""

from . import chat, langid, lm, media, mixing, neardup, packing, quality, toxicity, warc

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in (chat, langid, lm, media, mixing, neardup, packing, quality, toxicity, warc):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
