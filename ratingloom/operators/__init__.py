"""Dataflow steps on ratings; each takes and returns DataFrames."""
