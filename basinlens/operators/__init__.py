"""DataFrame in, DataFrame out: the relational operators."""
