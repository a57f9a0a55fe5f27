"""Structured Streaming forms of intake, leases, budgets and upserts.  The
reference behaviour is a poll loop; these give the same rows as the batch."""
