"""The query surface over a snapshot: validated filters, whitelisted sorts, pages, details, name lookup."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.scalars import all_of


class AmbiguousError(ValueError):
    """Several rows match a name."""


@dataclass
class Page:
    """What to list. ``bounds``: column to (low, high), either None; bounds drop nulls."""

    sort: str
    descending: bool | None = None
    include_unranked: bool = False
    equal: dict[str, object] = field(default_factory=dict)
    bounds: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    query: str | None = None
    limit: int = 100
    offset: int = 0


class Store:
    """``sorts`` maps public names to columns, or to (column, descending by default); nothing else can be sorted by.

    ``parent`` names a column of the parent's name, which searches look at too; ``state`` one that may follow a name.
    """

    def __init__(self, table: DataFrame, key: str, name: str, sorts: dict[str, str | tuple[str, bool]], parent: str | None = None, state: str | None = None):
        self.table, self.key, self.name, self.parent, self.state = table, key, name, parent, state
        self.sorts = {k: v if isinstance(v, str) else v[0] for k, v in sorts.items()}
        self.directions = {k: True if isinstance(v, str) else v[1] for k, v in sorts.items()}

    def _conditions(self, p: Page) -> list[Column]:
        if p.sort not in self.sorts:
            raise ValueError(f"unknown sort {p.sort}")
        if p.offset < 0:
            raise ValueError("offset must not be negative")
        for c, (low, high) in p.bounds.items():
            if any(x is not None and not math.isfinite(x) for x in (low, high)) or (low is not None and high is not None and low > high):
                raise ValueError(f"bad bounds for {c}")
        out = [F.lit(True)]
        if not p.include_unranked:
            out.append(F.col(self.sorts[p.sort]).isNotNull())
        out += [F.col(c) == v for c, v in p.equal.items()]
        out += [F.col(c) >= low for c, (low, _) in p.bounds.items() if low is not None]
        out += [F.col(c) <= high for c, (_, high) in p.bounds.items() if high is not None]
        if p.query:
            like = lambda c: F.coalesce(F.col(c).ilike(f"%{p.query}%"), F.lit(False))
            found = like(self.name) | (F.col(self.key).cast("string") == p.query)
            out.append(found | like(self.parent) if self.parent else found)
        return out

    def list(self, p: Page) -> DataFrame:
        """One page: nulls last, ties by key; the sort's own direction unless one is given."""
        c = F.col(self.sorts[p.sort]) if p.sort in self.sorts else None
        rows = self.table.where(all_of(self._conditions(p)))
        down = self.directions.get(p.sort, True) if p.descending is None else p.descending
        order = c.desc_nulls_last() if down else c.asc_nulls_last()
        return rows.orderBy(order, self.key).offset(p.offset).limit(max(1, min(500, p.limit)))

    def total(self, p: Page) -> int:
        return self.table.where(all_of(self._conditions(p))).count()

    def detail(self, key, members: DataFrame | None = None, member_of: str | None = None, records: Sequence[dict[str, str]] = (), notices: Sequence[str] = ()) -> dict | None:
        """One row; with the number of its ``members`` (rows whose ``member_of`` is the key), a record for each of ``records`` and notices.

        A record names columns by what it calls them: ``{"code": "wfir", "percentile": "wfir_p"}``; ``code`` is taken as it is.
        """
        row = self.table.where(F.col(self.key) == key).first()
        if row is None:
            return None
        out = row.asDict()
        if records:
            out["records"] = [{k: v if k == "code" else out.get(v) for k, v in r.items()} for r in records]
        if members is not None:
            out["member_count"] = members.where(F.col(member_of) == key).count()
        if notices:
            out["notices"] = list(notices)
        return out

    def resolve(self, name: str):
        """The key of the one row with this name, letter case aside, or ``name, ST``; several fail with candidates.

        A text that is a key stands for itself.
        """
        shown = [self.key, self.name, *([self.state] if self.state else [])]
        own = self.table.where(F.col(self.key).cast("string") == name.strip()).select(self.key).first()
        if own is not None:
            return own[0]
        head, comma, tail = name.rpartition(",")
        if self.state and comma:
            found = self.table.where((F.lower(self.name) == head.strip().lower()) & (F.col(self.state) == tail.strip().upper()))
        else:
            found = self.table.where(F.lower(self.name) == name.strip().lower())
        got = found.select(*shown).orderBy(self.key).limit(11).collect()
        if len(got) > 1:
            raise AmbiguousError([tuple(r) for r in got])
        return got[0][0] if got else None

    def columns(self, names: Sequence[str]) -> dict[str, list]:
        """Aligned arrays ordered by key, for a client: the one place where a whole (grain) table reaches the driver."""
        t = self.table.select(self.key, *names).orderBy(self.key).toArrow()
        return {c: t.column(c).to_pylist() for c in t.column_names}
