"""Operators composed into whole plans, and what they give out."""
