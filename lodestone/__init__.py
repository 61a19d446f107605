"""Typed binary tables, archives, media chunk streams and cue graphs as Spark DataFrames."""
