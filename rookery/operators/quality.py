"""Matching of expected with found changes, the measures made of it, and the gate over them.

Matching is greedy in the order of the expectations and one-to-one, so it depends on order and runs per case, a hand-written list held
against one diff. Only fields an expectation supplies are compared: found changes are looked up by the fields' values in one table for
each set of supplied fields, so a case costs time in proportion to its size. Rates of nothing are null.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rookery.operators.diff import DIFF_SQL, changes
from rookery.plans.views import all_units

FIELDS = ("path", "baseline_path", "symbol", "baseline_symbol", "unit_id", "baseline_unit_id")
MATCH = "case_id string, outcome string, expected_type string, actual_type string, unit_id string"


def match_lists(expected: list[dict], actual: list[dict]) -> list[tuple[str, dict | None, dict | None]]:
    """(outcome, expected, actual): exact, mismatch, missing, unexpected."""
    free, tables, out = [True] * len(actual), {}, []

    def first(fields: tuple[str, ...], values: tuple) -> int | None:
        """The first found change not taken yet with these values, taken now."""
        if fields not in tables:
            table: dict[tuple, deque[int]] = {}
            for i, a in enumerate(actual):
                table.setdefault(tuple(a.get(f) for f in fields), deque()).append(i)
            tables[fields] = table
        places = tables[fields].get(values, deque())
        while places and not free[places[0]]:
            places.popleft()
        return places[0] if places else None

    for e in expected:
        supplied = tuple(f for f in FIELDS if e.get(f) is not None)
        values = tuple(e[f] for f in supplied)
        exact = first((*supplied, "change_type"), (*values, e["change_type"]))
        hit = exact if exact is not None else first(supplied, values) if supplied else None
        if hit is not None:
            free[hit] = False
        out.append(("exact" if exact is not None else "missing" if hit is None else "mismatch", e, None if hit is None else actual[hit]))
    return out + [("unexpected", None, a) for a, left in zip(actual, free) if left]


def matched(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row per outcome. ``expected`` has case_id, place, change_type and any of FIELDS; ``actual`` case_id, change_type, FIELDS."""
    cols = ["case_id", "change_type", *FIELDS]
    fill = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in cols], (F.col("place") if "place" in df.columns else F.lit(0)).alias("place"))
    both = fill(expected).withColumn("side", F.lit("e")).unionByName(fill(actual).withColumn("side", F.lit("a")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.astype(object).where(pdf.notna(), None).sort_values(["place", "change_type", "path", "baseline_path", "unit_id", "baseline_unit_id"], na_position="first", kind="stable")
        rows = lambda s: pdf[pdf["side"] == s].to_dict("records")
        case = pdf["case_id"].iloc[0]
        got = [(case, o, e and e["change_type"], a and a["change_type"], (a or e)["unit_id"] or (a or e)["baseline_unit_id"]) for o, e, a in match_lists(rows("e"), rows("a"))]
        return pd.DataFrame(got, columns=["case_id", "outcome", "expected_type", "actual_type", "unit_id"])

    return both.groupBy("case_id").applyInPandas(run, MATCH)


def measures(m: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates by ``keys``; summed over cases, not averaged."""
    n = lambda c: F.count_if(c)
    o, e = F.col("outcome"), F.col("expected_type")
    wanted, exact = o != "unexpected", o == "exact"
    move, kind = e == "moved_or_renamed", e.isin("implementation_changed", "meaning_changed")
    rate = lambda a, b: F.when(n(b) > 0, n(a) / n(b))
    return m.groupBy(*keys).agg(
        n(wanted).alias("expected"), n(exact).alias("exact"), n(o == "mismatch").alias("mismatches"), n(o == "missing").alias("missing"), n(~wanted).alias("unexpected"),
        rate(exact, wanted).alias("match_rate"), rate(exact & move, move).alias("move_rate"), rate(exact & kind, kind).alias("kind_rate"), rate(~wanted, F.col("actual_type").isNotNull()).alias("unmatched_rate"),
    )


#: Measures, whether more of them is better, and the least (greatest) value that passes (fixed values).
THRESHOLDS = {"match_rate": (True, 0.95), "move_rate": (True, 0.95), "kind_rate": (True, 0.95), "stable_rate": (True, 0.95), "unmatched_rate": (False, 0.05)}


def gate(m: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """metric, threshold, value, applicable, passed of one row of ``measures``; a measure of nothing passes. Eligible: all passed."""
    limits = {k: (up, (thresholds or {}).get(k, v)) for k, (up, v) in THRESHOLDS.items() if k in m.columns}
    flat = m.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(up).alias("up"), F.lit(v).alias("threshold"), F.col(k).alias("value")) for k, (up, v) in limits.items()])))
    ok = F.when(F.col("up"), F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return flat.select("metric", "threshold", "value", F.col("value").isNotNull().alias("applicable"), F.coalesce(ok, F.lit(True)).alias("passed"))


def eligible(checks: DataFrame) -> bool:
    return bool(checks.agg(F.coalesce(F.bool_and("passed"), F.lit(True))).first()[0])


def review_samples(m: DataFrame, limit: int = 10) -> DataFrame:
    """The first ``limit`` outcomes of each kind but exact ones, per case, in the order of their units."""
    w = Window.partitionBy("case_id", "outcome").orderBy("unit_id", "expected_type", "actual_type")
    return m.where("outcome <> 'exact'").withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(1, limit))


def report(expected: DataFrame, actual: DataFrame, thresholds: dict[str, float] | None = None, limit: int = 10) -> dict[str, DataFrame]:
    """Cases, summary, gate and samples of a dataset of expectations against found changes."""
    m = matched(expected, actual)
    whole = measures(m, [])
    return {"cases": measures(m, ["case_id"]), "summary": whole, "gate": gate(whole, thresholds), "samples": review_samples(m, limit)}


def _expected(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Expectations made from the found changes by dropping some and misnaming some, by a hash of the unit."""
    a = changes(all_units(spark, d)).withColumn("case_id", F.concat_ws("#", "root", "snapshot_id"))
    h = F.ascii(F.substring(F.md5(F.coalesce("unit_id", "baseline_unit_id")), 1, 1)) % 7
    e = a.where(h != 0).withColumn("change_type", F.when(h == 1, "meaning_changed").otherwise(F.col("change_type"))).withColumn("place", F.lit(0))
    return e, a


def _counts(m: DataFrame, keys: list[str]) -> DataFrame:
    rounded = lambda c: F.round(c, 9).alias(c)
    return measures(m, keys).select(*keys, "expected", "exact", "mismatches", "missing", "unexpected", *[rounded(c) for c in ("match_rate", "move_rate", "kind_rate", "unmatched_rate")])


QUERIES = {
    "join_22_matched": lambda s, d: _counts(matched(*_expected(s, d)), ["case_id"]),
    "agg_21_gate": lambda s, d: gate(_counts(matched(*_expected(s, d)), [])),
    "orc_10_samples": lambda s, d: review_samples(matched(*_expected(s, d)), 3),
}
# every expectation supplies all its fields and unit ids are unique, so it can only meet the change it was made from
_OUT = (
    DIFF_SQL
    + """, aa as (select *, concat_ws('#', root, snapshot_id) as case_id, ascii(md5(coalesce(unit_id, baseline_unit_id))[1]) % 7 as h from ch where change_type <> 'unchanged'),
oo as (select case_id, coalesce(unit_id, baseline_unit_id) as unit_id, change_type as actual_type, case when h = 0 then null when h = 1 then 'meaning_changed' else change_type end as expected_type,
    case when h = 0 then 'unexpected' when h = 1 and change_type <> 'meaning_changed' then 'mismatch' else 'exact' end as outcome from aa)
"""
)
_RATE = lambda a, b: f"round((count(*) filter ({a}))::double / nullif(count(*) filter ({b}), 0), 9)"
_MEASURES = (
    "count(*) filter (outcome <> 'unexpected') as expected, count(*) filter (outcome = 'exact') as exact, count(*) filter (outcome = 'mismatch') as mismatches, count(*) filter (outcome = 'missing') as missing, count(*) filter (outcome = 'unexpected') as unexpected, "
    + f"{_RATE('outcome = ' + repr('exact'), 'outcome <> ' + repr('unexpected'))} as match_rate, "
    + f"{_RATE('outcome = ' + repr('exact') + ' and expected_type = ' + repr('moved_or_renamed'), 'expected_type = ' + repr('moved_or_renamed'))} as move_rate, "
    + f"{_RATE('outcome = ' + repr('exact') + ' and expected_type in (' + repr('implementation_changed') + ', ' + repr('meaning_changed') + ')', 'expected_type in (' + repr('implementation_changed') + ', ' + repr('meaning_changed') + ')')} as kind_rate, "
    + f"{_RATE('outcome = ' + repr('unexpected'), 'actual_type is not null')} as unmatched_rate"
)
SQL = {
    "join_22_matched": _OUT + f"select case_id, {_MEASURES} from oo group by case_id",
    "agg_21_gate": _OUT
    + f", mm as (select {_MEASURES} from oo) "
    + " union all ".join(f"select '{k}' as metric, {v}::double as threshold, {k} as value, {k} is not null as applicable, coalesce({k} {'>=' if up else '<='} {v}, true) as passed from mm" for k, (up, v) in THRESHOLDS.items() if k != "stable_rate"),
    "orc_10_samples": _OUT + "select * from (select case_id, outcome, expected_type, actual_type, unit_id, row_number() over (partition by case_id, outcome order by unit_id, expected_type, actual_type)::int as place from oo where outcome <> 'exact') where place <= 3",
}
