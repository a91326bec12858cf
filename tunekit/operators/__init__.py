"""DataFrame operators: preparation, selection, training, validation, trial log, proposals."""
