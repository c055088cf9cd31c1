"""Table operators: profiling, cleaning, preparation, splitting, training,
evaluation, explanation, scoring and run-registry queries."""
