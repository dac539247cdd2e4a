"""The queries and SQL of this package."""

from . import byte_bpe, decontaminate, hard_negatives, jaccard_join, lm_score, piece_scan, quality, secrets, sharding, token_output, toxicity, url_filter, whitening

MODULES = [byte_bpe, decontaminate, hard_negatives, jaccard_join, lm_score, piece_scan, quality, secrets, sharding, token_output, toxicity, url_filter, whitening]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
