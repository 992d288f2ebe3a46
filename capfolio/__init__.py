"""Capital-portfolio analytics as lazy Spark plans.

Four all-text source tables go in; typed period snapshots, the schedule/budget
link table, lifetime variance, dimensions and the analytic operators come out.
See ``capfolio.plans.tables.Tables`` for the entry point.
"""

from capfolio.plans.tables import Tables

__all__ = ["Tables"]
