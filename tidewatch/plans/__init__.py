"""Composed jobs: scoring engine, training, adaptation."""
