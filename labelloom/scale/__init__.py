"""Staging, size-checked joins and distributed ordering shared by the operators."""
