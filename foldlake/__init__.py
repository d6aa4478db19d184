"""Keyed-edit analytics on Spark: an append-only edit log folded into one current value per key."""
