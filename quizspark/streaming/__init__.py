"""Micro-batch forms of the stages that keep no state between documents."""
