"""Whole pipelines, wired from operators."""
