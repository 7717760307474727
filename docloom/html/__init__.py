"""HTML: a tolerant tree builder and what is made of its trees."""
