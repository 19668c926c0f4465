"""Readers: access logs of several servers, source trees, rule files, manifests."""
