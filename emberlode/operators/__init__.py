"""Dataflow operators."""
