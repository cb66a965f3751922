"""Whole-pipeline plans and the registered queries."""
