"""Jobs built from the operators: preparation, baselines, models, sweeps."""
