"""DataFrame operators: lookups and reconciliation, splits and folds, regression and its metrics, ordering."""
