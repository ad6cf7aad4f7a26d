"""Streams of samples: running totals, and sketches that are made once and compared with those kept."""
