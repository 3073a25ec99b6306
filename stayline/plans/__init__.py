"""Composite queries: the clinical views, the feature build, training, scoring, explanation."""
