"""Which physical strategy a traversal takes."""
