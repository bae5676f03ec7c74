"""DataFrame -> DataFrame operators; see the modules."""
