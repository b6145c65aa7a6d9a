"""DataFrame-to-DataFrame operators. None of them collects; order and ties are always total."""
