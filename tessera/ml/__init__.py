"""Model training, evaluation and selection."""
