"""DataFrame operators grouped by business area."""
