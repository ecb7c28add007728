"""Imports every module that registers queries."""

from tessera.plans import audits, backtest, events, factors, misc, state, streams, trading, xsection  # noqa: F401

FLAGSHIP = "fa3_mom_1_top5"
