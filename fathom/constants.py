"""Semantic limits and formula constants, in one place."""

DEFAULT_K, MAX_K, SCROLL_LIMIT = 10, 10_000, 10
RERANK_PREFETCH = 3
BM25_K1, BM25_B = 1.5, 0.75
RRF, RRF_TEXT = 60, 10
TEXT_DEPTH, TEXT_QUERY_BYTES = 4, 8192
FLAT_BRANCH = 0.5
TEMPORAL_BATCH, TEMPORAL_HISTORY, SERIES_BYTES = 1024, 4096, 4096
GRAPH_ANCHORS, GRAPH_TYPES, GRAPH_DEPTH, GRAPH_BATCH, EDGE_BYTES = 128, 64, 16, 4096, 64 << 10
TRAVERSE_DEPTH, CONNECTED_HOPS = 5, 1
FILTER_DEPTH, FILTER_NODES, FILTER_ITEMS, FILTER_FIELD = 16, 1024, 256, 256
SQL_DEPTH, SQL_STATEMENTS, SQL_BYTES = 32, 32, 8 << 20
MULTI_BRANCHES, MAX_DIMENSION, UPSERT_POINTS = 128, 65_536, 10_000
ML_ROWS, ML_SEED = 10_000, 42
#: Broadcast a side of at most this many narrow rows; larger ones are left to Catalyst.
BROADCAST_ROWS = 100_000
