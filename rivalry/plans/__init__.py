"""Registered queries of the contest operators."""

from rivalry.plans import features, link, models, quality, rolling, scoring, sources

REGISTRIES = [features.R, link.R, quality.R, scoring.R, models.R, rolling.R, sources.R]
