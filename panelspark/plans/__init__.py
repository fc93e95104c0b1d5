"""Staged models built on Spark ML: boosted trees, linear, multinomial and ordered-probit models, attributions."""
