"""Retail customer tiers and revenue concentration as PySpark DataFrame functions."""
