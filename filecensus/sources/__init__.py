"""Readers and writers: listings, snapshots, file trees, plans, reports and heartbeats."""
