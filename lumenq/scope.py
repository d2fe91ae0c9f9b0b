"""Tenant and environment scope of a read, to be applied to every input before any join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Env:
    """kind: all, one, subset (no null ever matches) or unattributed (null only)."""

    kind: str = "all"
    ids: tuple[str, ...] = ()

    @staticmethod
    def one(i: str) -> "Env":
        return Env("one", (i,))

    @staticmethod
    def subset(ids) -> "Env":
        return Env("subset", tuple(ids))

    def condition(self, c: Column) -> Column | None:
        match self.kind:
            case "all":
                return None
            case "one":
                return c == self.ids[0]
            case "subset":
                return c.isin(*self.ids) if self.ids else F.lit(False)
            case "unattributed":
                return c.isNull()
        raise ValueError(self.kind)


@dataclass(frozen=True)
class Scope:
    """``app_id`` None: all apps that the caller may see, given as ``apps`` (None: every app)."""

    app_id: str | None = None
    env: Env = Env()
    apps: tuple[str, ...] | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        if self.app_id is not None:
            df = df.filter(F.col("app_id") == self.app_id)
        elif self.apps is not None:
            df = df.filter(F.col("app_id").isin(*self.apps) if self.apps else F.lit(False))
        c = self.env.condition(F.col("environment_id")) if "environment_id" in df.columns else None
        return df if c is None else df.filter(c)


ALL = Scope()


def narrow(grants: list[Env], wanted: Env) -> Env:
    """The environments of a union of grants, narrowed to those wanted; without a grant nothing is readable."""
    if any(g.kind == "all" for g in grants):
        return wanted
    mine = {i for g in grants for i in g.ids}
    if wanted.kind == "all":
        return Env.subset(sorted(mine))
    if wanted.kind == "unattributed":
        return wanted if any(g.kind == "unattributed" for g in grants) else Env.subset(())
    kept = tuple(i for i in wanted.ids if i in mine)
    return Env(wanted.kind, kept) if kept else Env.subset(())
