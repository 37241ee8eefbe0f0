"""Equi joins with the missing-value rules of the flow analyses.

No join is hinted: adaptive execution broadcasts a side whose measured size is under the session's threshold, and
otherwise shuffles and splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

By = str | Sequence[str] | Mapping[str, str] | None


def _pairs(left: DataFrame, right: DataFrame, by: By) -> list[tuple[str, str]]:
    if by is None:
        common = [c for c in left.columns if c in right.columns]
        if not common:
            raise ValueError("the tables have no column in common; give `by`")
        return [(c, c) for c in common]
    if isinstance(by, str):
        return [(by, by)]
    if isinstance(by, Mapping):
        return list(by.items())
    return [(c, c) for c in by]


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def join(
    left: DataFrame,
    right: DataFrame,
    by: By = None,
    how: str = "left",
    na_matches: str = "na",
    suffix: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Join on ``by`` (all common columns when omitted); ``{left: right}`` for differently named keys.

    ``how``: left, right, inner, full, semi, anti. The key keeps the left name and is coalesced in right and full
    joins. ``na_matches="na"`` lets a missing key meet a missing key; ``"never"`` uses plain equality, which
    Catalyst can push filters through. Other columns present on both sides get the suffixes.
    """
    pairs = _pairs(left, right, by)
    tmp = {r: f"__key_{i}" for i, (_, r) in enumerate(pairs)}

    def same(a: Column, b: Column) -> Column:
        return a.eqNullSafe(b) if na_matches == "na" else a == b

    cond = reduce(lambda a, b: a & b, [same(_quoted(l), F.col(tmp[r])) for l, r in pairs])
    if how in ("semi", "anti"):
        keys = right.select(*[_quoted(r).alias(tmp[r]) for _, r in pairs])
        return left.join(keys, cond, f"left_{how}")

    keys_l = [l for l, _ in pairs]
    rest_l = [c for c in left.columns if c not in keys_l]
    rest_r = [c for c in right.columns if c not in tmp]
    clash = set(rest_l) & set(rest_r)
    lhs = left.withColumnsRenamed({c: c + suffix[0] for c in clash})
    # a right column named like a left key stays apart through the suffix as well
    name_r = {c: c + suffix[1] if c in clash or c in keys_l else c for c in rest_r}
    rhs = right.withColumnsRenamed({**tmp, **name_r})
    joined = lhs.join(rhs, cond, how)

    def key(l: str, r: str) -> Column:
        if how == "right":
            return F.col(tmp[r]).alias(l)
        if how == "full":
            return F.coalesce(_quoted(l), F.col(tmp[r])).alias(l)
        return _quoted(l)

    by_left = dict(pairs)
    cols = [key(c, by_left[c]) if c in by_left else _quoted(c + suffix[0] if c in clash else c) for c in left.columns]
    return joined.select(*cols, *[_quoted(name_r[c]) for c in rest_r])


def map_areas(
    df: DataFrame,
    xwalk: DataFrame | Mapping[str, DataFrame],
    key: str,
    level: str,
    roles: Mapping[str, str],
    how: str = "left",
) -> DataFrame:
    """Attach the area of each end of a flow: one dimension joined once per role ``{code column: new column}``.

    ``xwalk`` may hold one table per role. Its key is never missing, so plain equality is used.
    """
    for src, out in roles.items():
        table = xwalk[src] if isinstance(xwalk, Mapping) else xwalk
        df = join(df, table.select(F.col(key).alias(src), F.col(level).alias(out)), src, how, "never")
    return df


def restrict_to(df: DataFrame, areas: DataFrame, cols: Sequence[str], key: str = "GEOID") -> DataFrame:
    """Keep flows whose ends are all in the area table."""
    for c in cols:
        df = join(df, areas, by={c: key}, how="semi", na_matches="never")
    return df


def active_areas(
    areas: DataFrame, flows: DataFrame, origin: str, dest: str, key: str = "GEOID"
) -> DataFrame:
    """Areas that occur both as an origin and as a destination."""
    for c in (origin, dest):
        areas = join(areas, flows.select(c).distinct(), by={key: c}, how="semi", na_matches="never")
    return areas


def destinations_of(
    flows: DataFrame, areas: DataFrame, at: object, origin: str, dest: str, key: str = "GEOID"
) -> DataFrame:
    """Areas reached from one origin."""
    return join(areas, flows.filter(F.col(origin) == F.lit(at)), by={key: dest}, how="semi", na_matches="never")


def attach(df: DataFrame, other: DataFrame, key: By) -> DataFrame:
    """Put two tables side by side by key (never by row position)."""
    return join(df, other, by=key, how="left", na_matches="never")
