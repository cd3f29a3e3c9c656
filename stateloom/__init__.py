"""Regime discovery and testing for multi-session time series, on Spark DataFrames.

Tables are tidy and keyed by (session_id, t): `obs` has y ARRAY<DOUBLE> and, if there are regressors, x; `gamma` has
state probabilities; `vpath` has state INT (from 0). t counts from 0 inside a session."""
