"""A stand-in scorer for tests of the plug-in protocol."""


def hashed_bag():
    """Factory of a scorer with logits from the lengths of the words; it
    claims no accuracy. Nested, so that it travels to the workers by value."""
    def factory():
        return lambda texts: [[sum(len(w) % 3 == k for w in t.split()) / 10 for k in range(3)] for t in texts]
    return factory
