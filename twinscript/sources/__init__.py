"""Reading decks and files, writing results."""
