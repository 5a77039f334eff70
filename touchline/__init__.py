"""Match-tracking analytics on Spark: causal context, features, labels, evaluation, editorial policy."""
