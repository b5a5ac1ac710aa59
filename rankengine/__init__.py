"""Leaderboard analytics as Spark jobs: ingest, scoring, requests and quality gates."""
