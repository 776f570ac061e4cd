"""Named views, their registry, and the analyses built on them."""
