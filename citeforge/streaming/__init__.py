"""Micro-batches of venue strings: match what is new, once."""
