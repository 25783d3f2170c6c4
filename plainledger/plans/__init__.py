"""Registered queries: the operators bound to the star-schema tables."""

from plainledger.plans import documents, evidence, funding, ops, registry, search, streams, text, versions, web

ALL_PLANS = (funding, registry, documents, web, text, evidence, ops, versions, search, streams)
