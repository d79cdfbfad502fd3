"""Plans built from several operators."""
