"""Workflows and the registered queries built from the operators."""
