"""Imports every module that registers queries."""

from cuespan.plans import agg_queries, board_queries, caption_queries, frame_queries, io_queries, join_queries, plan_queries, rule_queries, text_queries, window_queries  # noqa: F401
