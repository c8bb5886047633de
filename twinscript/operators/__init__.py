"""DataFrame operators. Keys start with ``deck_id`` so that many decks share one table."""
