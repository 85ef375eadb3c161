"""Claim-record analytics as Spark plans."""
