"""Inputs: text, slides, PDF words, web pages; model providers."""
