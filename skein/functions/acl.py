"""Row-level access control."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Access levels in rising order.
LEVELS = ("public", "employee", "manager", "admin")


@dataclass(frozen=True)
class AccessContext:
    """Who asks: stripped and lower-cased; an unknown level raises."""

    department: str = "public"
    access_level: str = "public"
    include_archived: bool = False

    def __post_init__(self):
        object.__setattr__(self, "department", (self.department or "public").strip().lower())
        object.__setattr__(self, "access_level", (self.access_level or "public").strip().lower())
        if self.access_level not in LEVELS:
            raise ValueError(f"unknown access level {self.access_level!r}; one of {LEVELS}")

    @property
    def is_admin(self) -> bool:
        return self.access_level == LEVELS[-1]

    @property
    def allowed_levels(self) -> list[str]:
        return list(LEVELS[: LEVELS.index(self.access_level) + 1])


def acl_predicate(ctx: AccessContext, department: str | Column = "department", access_level: str | Column = "access_level", status: str | Column = "status") -> Column:
    """Exact comparisons, pushed down to the scan; whatever isn't known to be allowed is denied, nulls too.

    An administrator passes every level and department but not the archive.
    """
    dep, lev, st = (F.col(c) if isinstance(c, str) else c for c in (department, access_level, status))
    out = F.lit(True) if ctx.include_archived else st == "active"
    if not ctx.is_admin:
        out = out & lev.isin(ctx.allowed_levels) & dep.isin(sorted({"public", ctx.department}))
    return F.coalesce(out, F.lit(False))


def acl_predicate_lenient(ctx: AccessContext, department: str = "department", access_level: str = "access_level", status: str = "status") -> Column:
    """The in-memory form: values are trimmed and lower-cased, nulls get their defaults, an unknown level ranks lowest, only archived rows are blocked by status."""
    norm = lambda c, default: F.lower(F.trim(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))))
    out = F.lit(True) if ctx.include_archived else norm(status, "active") != "archived"
    if ctx.is_admin:
        return out
    level = norm(access_level, "public")
    rank = F.lit(0)
    for i, name in enumerate(LEVELS):
        rank = F.when(level == name, i).otherwise(rank)
    dep = norm(department, "public")
    return out & (rank <= LEVELS.index(ctx.access_level)) & ((dep == "public") | (dep == ctx.department))
