"""Checked queries over the test tables; importing a module registers its queries."""

from notelake.plans import big, chained, evaluate, feeds, fingering, joins, licks, segment, shapes, spectral, tabs, theory, voting, windows  # noqa: F401
from notelake.plans.registry import ORACLE, QUERIES  # noqa: F401
