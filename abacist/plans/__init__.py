"""Reusable distributed plans: ordering, quantiles, moments, neighbours."""
