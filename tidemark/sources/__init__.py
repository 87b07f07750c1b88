"""Readers of feeds, site maps and notices, and sinks in the shared folder."""
