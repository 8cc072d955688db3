"""Batched, ragged, array-valued data pipelines as lazy DataFrame plans."""
