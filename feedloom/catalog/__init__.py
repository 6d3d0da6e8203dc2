"""Registry of runnable queries over the test tables, each with its SQL counterpart."""
