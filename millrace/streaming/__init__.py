"""Micro-batch forms of the monitoring operators."""
