"""Row sources and catalog reads."""
