"""Operators for training corpora: text in, decisions, spans, scores and rates out."""
