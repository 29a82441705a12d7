"""Logical plans, rewrites, costs, policies and the choice of implementations."""
