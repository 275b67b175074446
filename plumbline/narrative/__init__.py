"""Findings in words: a language model may propose and phrase, the statistics decide."""
