"""Durable tables: operation log, snapshots, manifest."""
