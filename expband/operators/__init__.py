"""DataFrame operators: text features, folds, weights, models, combiner, metrics."""
