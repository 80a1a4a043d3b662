"""Games as examples and as tests of the whole engine."""
