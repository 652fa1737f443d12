"""The registered queries and their SQL: the reports and tables of `panelmill.queries`, and the operators of `catalogue`."""

from panelmill.plans.catalogue import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
