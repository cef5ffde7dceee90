"""DataFrame transforms: every function takes frames and returns a lazy frame."""
