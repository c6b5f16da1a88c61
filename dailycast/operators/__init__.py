"""DataFrame-in, DataFrame-out operators; every one takes optional series keys."""
