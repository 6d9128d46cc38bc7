"""Stage plans."""
