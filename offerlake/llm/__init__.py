"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from . import divergence_rules, html_layout, lang_id, lexical, ngram_join, order_minhash, quality_gbt, simhash, soft_mixing, sp_unigram, token_align, url_cascade, warc_shards  # noqa: F401
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
