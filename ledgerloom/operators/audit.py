"""Identities between facts of a document, repairs of signs, ratios, and the facts under suspicion. Rules are data; one wide row per document is made by one conditional aggregate.

The facts audited are those of the current period: marked so, or whose period is the year of the report.
Two amounts are equal within 2 units or a ten-thousandth. Checks run in the order of their ids; the signs
of cash flows are repaired before the checks that use them.
"""

from __future__ import annotations

import itertools
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import approx_equal, ratio
from ledgerloom.operators.facts import PRIORITY, winners
from ledgerloom.tables import table

# Parts of totals, by concept.
PARTS_SHORT = ["CASH_POOL", "DEPOSIT_SHORT", "RECV_CUSTOMER_SHORT", "STOCK_NET", "PREPAID_SHORT"]
PARTS_LONG = ["RECV_CUSTOMER_LONG", "FIXED_TANGIBLE_COST", "RENTAL_PROPERTY", "BUILD_IN_PROGRESS", "DEPOSIT_LONG", "PREPAID_LONG"]
FLOW_INDIRECT = ["FLOW_BEFORE_CHANGES", "FLOW_RECEIVABLES", "FLOW_STOCK", "FLOW_PAYABLES", "FLOW_PREPAID", "FLOW_TRADING", "FLOW_INTEREST", "FLOW_TAX", "FLOW_OTHER_IN", "FLOW_OTHER_OUT"]
FLOW_DIRECT = ["DIRECT_SALES", "DIRECT_SUPPLIERS", "DIRECT_STAFF", "DIRECT_INTEREST", "DIRECT_TAX", "DIRECT_OTHER_IN", "DIRECT_OTHER_OUT"]
FLOW_INVESTED = ["FLOW_CAPEX", "FLOW_DISPOSAL", "FLOW_LENT", "FLOW_LENT_BACK", "FLOW_STAKES_OUT", "FLOW_STAKES_IN", "FLOW_YIELD"]
FLOW_FINANCED = ["FLOW_EQUITY_IN", "FLOW_CAPITAL_BACK", "FLOW_LOAN_IN", "FLOW_LOAN_OUT", "FLOW_LEASE_OUT", "FLOW_DIVIDEND"]
FLOWS = ["FLOW_OPERATING", "FLOW_INVESTING", "FLOW_FINANCING"]


class Rule(NamedTuple):
    """An identity: left = sum of terms (concept, sign, whether by size). Needed: left, all of `all_of`, and one of `any_of` if there are any; other terms count 0 when missing."""

    id: int
    name: str
    left: str
    terms: list[tuple[str, int, bool]]
    all_of: list[str]
    any_of: list[str]
    verified: list[str]  # whose status a pass sets
    blamed: list[str]  # whose status a failure sets
    silent: bool = False  # a failure with under three terms and within 5 % is passed over


def _plus(*concepts: str) -> list[tuple[str, int, bool]]:
    return [(c, 1, False) for c in concepts]


RULES = [
    Rule(1, "assets = sources", "ASSETS_TOTAL", _plus("SOURCES_TOTAL"), ["SOURCES_TOTAL"], [], ["ASSETS_TOTAL", "SOURCES_TOTAL"], ["ASSETS_TOTAL", "SOURCES_TOTAL"]),
    Rule(2, "assets = short + long", "ASSETS_TOTAL", _plus("ASSETS_SHORT", "ASSETS_LONG"), ["ASSETS_SHORT", "ASSETS_LONG"], [], ["ASSETS_SHORT", "ASSETS_LONG"], ["ASSETS_SHORT", "ASSETS_LONG"]),
    Rule(3, "short assets = parts", "ASSETS_SHORT", _plus(*PARTS_SHORT), [], PARTS_SHORT, ["ASSETS_SHORT", *PARTS_SHORT], ["ASSETS_SHORT"], True),
    Rule(4, "long assets = parts", "ASSETS_LONG", _plus(*PARTS_LONG), [], PARTS_LONG, ["ASSETS_LONG", *PARTS_LONG], ["ASSETS_LONG"], True),
    Rule(5, "sources = debt + equity", "SOURCES_TOTAL", _plus("DEBT_TOTAL", "EQUITY_TOTAL"), ["DEBT_TOTAL", "EQUITY_TOTAL"], [], ["DEBT_TOTAL", "EQUITY_TOTAL"], ["DEBT_TOTAL", "EQUITY_TOTAL"]),
    Rule(6, "debt = short + long", "DEBT_TOTAL", _plus("DEBT_SHORT", "DEBT_LONG"), [], ["DEBT_SHORT", "DEBT_LONG"], ["DEBT_TOTAL", "DEBT_SHORT", "DEBT_LONG"], ["DEBT_TOTAL"]),
    Rule(7, "net revenue = gross - cuts", "REVENUE_NET", [("REVENUE_GROSS", 1, False), ("REVENUE_CUT", -1, True)], ["REVENUE_GROSS", "REVENUE_CUT"], [], ["REVENUE_NET", "REVENUE_GROSS"], ["REVENUE_NET"]),
    Rule(8, "gross profit = net revenue - cost", "PROFIT_GROSS", [("REVENUE_NET", 1, False), ("COST_SALES", -1, True)], ["REVENUE_NET", "COST_SALES"], [], ["PROFIT_GROSS", "REVENUE_NET", "COST_SALES"], []),
    Rule(9, "operating profit", "PROFIT_OPERATING", [("PROFIT_GROSS", 1, False), ("INCOME_FINANCE", 1, True), ("COST_FINANCE", -1, True), ("COST_SELLING", -1, True), ("COST_ADMIN", -1, True)], ["PROFIT_GROSS"], ["INCOME_FINANCE", "COST_FINANCE", "COST_SELLING", "COST_ADMIN"], ["PROFIT_OPERATING"], ["PROFIT_OPERATING"]),
    Rule(10, "other profit", "PROFIT_OTHER", [("INCOME_OTHER", 1, True), ("COST_OTHER", -1, True)], [], ["INCOME_OTHER", "COST_OTHER"], ["PROFIT_OTHER"], ["PROFIT_OTHER"]),
    Rule(11, "profit before tax", "PROFIT_PRETAX", _plus("PROFIT_OPERATING", "PROFIT_OTHER"), ["PROFIT_OPERATING", "PROFIT_OTHER"], [], ["PROFIT_PRETAX", "PROFIT_OPERATING", "PROFIT_OTHER"], ["PROFIT_PRETAX"]),
    Rule(12, "profit after tax", "PROFIT_NET", [("PROFIT_PRETAX", 1, False), ("TAX_CURRENT", -1, True), ("TAX_DEFERRED", -1, True)], ["PROFIT_PRETAX"], ["TAX_CURRENT", "TAX_DEFERRED"], ["PROFIT_NET"], ["PROFIT_NET"]),
    Rule(13, "flow of financing = parts", "FLOW_FINANCING", [(c, s, True) for c, s in zip(FLOW_FINANCED, (1, -1, 1, -1, -1, -1), strict=True)], [], FLOW_FINANCED, ["FLOW_FINANCING"], ["FLOW_FINANCING"]),
    Rule(14, "change of cash = three flows", "FLOW_NET", _plus(*FLOWS), FLOWS, [], ["FLOW_NET", *FLOWS], ["FLOW_NET"]),
    Rule(15, "closing cash = opening + change", "FLOW_CLOSING", _plus("FLOW_OPENING", "FLOW_NET", "FLOW_EXCHANGE"), ["FLOW_OPENING", "FLOW_NET"], [], ["FLOW_CLOSING"], ["FLOW_CLOSING"]),
    Rule(16, "closing cash = cash in the balance", "FLOW_CLOSING", _plus("CASH_POOL"), ["CASH_POOL"], [], ["FLOW_CLOSING", "CASH_POOL"], ["FLOW_CLOSING", "CASH_POOL"]),
    Rule(17, "profit before tax in both statements", "FLOW_PRETAX", _plus("PROFIT_PRETAX"), ["PROFIT_PRETAX"], [], ["FLOW_PRETAX", "PROFIT_PRETAX"], ["FLOW_PRETAX", "PROFIT_PRETAX"]),
]
# Words of a label that make the deferred tax a benefit.
BENEFIT = "lợi ích|thu nhập"
# By how much a passed check clears concepts, the left side first; checks not listed clear none.
CLEARED = {
    2: {"ASSETS_TOTAL": 15, "ASSETS_SHORT": 10, "ASSETS_LONG": 10},
    3: {"ASSETS_SHORT": 15} | dict.fromkeys(PARTS_SHORT, 10),
    4: {"ASSETS_LONG": 15},
    5: {"SOURCES_TOTAL": 15, "DEBT_TOTAL": 10, "EQUITY_TOTAL": 10},
    6: {"DEBT_TOTAL": 15, "DEBT_SHORT": 10, "DEBT_LONG": 10},
    7: {"REVENUE_NET": 10, "REVENUE_GROSS": 10, "REVENUE_CUT": 10},
    8: {"PROFIT_GROSS": 10, "REVENUE_NET": 10, "COST_SALES": 10},
    9: {"PROFIT_OPERATING": 15, "PROFIT_GROSS": 10},
    10: {"PROFIT_OTHER": 10, "INCOME_OTHER": 10, "COST_OTHER": 10},
    11: {"PROFIT_PRETAX": 10, "PROFIT_OPERATING": 10, "PROFIT_OTHER": 10},
    12: {"PROFIT_NET": 10, "PROFIT_PRETAX": 10},
    13: {"FLOW_FINANCING": 15, "FLOW_LOAN_IN": 10, "FLOW_LOAN_OUT": 10, "FLOW_DIVIDEND": 10},
    14: {"FLOW_NET": 15} | dict.fromkeys(FLOWS, 10),
    15: {"FLOW_CLOSING": 15, "FLOW_OPENING": 10, "FLOW_NET": 10},
    16: {"FLOW_CLOSING": 15, "CASH_POOL": 15},
    17: {"FLOW_PRETAX": 15, "PROFIT_PRETAX": 15},
}
# Ratios: name, category, numerator [(concept, sign)], denominator; all must be there and the denominator above 0.
RATIOS = [
    ("current_ratio", "liquidity", [("ASSETS_SHORT", 1)], "DEBT_SHORT"), ("quick_ratio", "liquidity", [("ASSETS_SHORT", 1), ("STOCK_NET", -1)], "DEBT_SHORT"), ("cash_ratio", "liquidity", [("CASH_POOL", 1)], "DEBT_SHORT"),
    ("debt_to_equity", "solvency", [("DEBT_TOTAL", 1)], "EQUITY_TOTAL"), ("debt_to_assets", "solvency", [("DEBT_TOTAL", 1)], "ASSETS_TOTAL"), ("financial_leverage", "solvency", [("ASSETS_TOTAL", 1)], "EQUITY_TOTAL"),
    ("gross_margin", "profitability", [("PROFIT_GROSS", 1)], "REVENUE_NET"), ("net_profit_margin", "profitability", [("PROFIT_NET", 1)], "REVENUE_NET"), ("operating_margin", "profitability", [("PROFIT_OPERATING", 1)], "REVENUE_NET"),
    ("roa", "profitability", [("PROFIT_NET", 1)], "ASSETS_TOTAL"), ("roe", "profitability", [("PROFIT_NET", 1)], "EQUITY_TOTAL"), ("asset_turnover", "efficiency", [("REVENUE_NET", 1)], "ASSETS_TOTAL"),
]
# Weights of the distress score, over assets but for the fourth, over debt; the second counts 0 when its fact is missing.
SCORE = [(0.717, [("ASSETS_SHORT", 1), ("DEBT_SHORT", -1)], "ASSETS_TOTAL"), (0.847, [("PROFIT_KEPT", 1)], "ASSETS_TOTAL"), (3.107, [("PROFIT_OPERATING", 1)], "ASSETS_TOTAL"), (0.420, [("EQUITY_TOTAL", 1)], "DEBT_TOTAL"), (0.998, [("REVENUE_NET", 1)], "ASSETS_TOTAL")]
SCORE_OPTIONAL = ["PROFIT_KEPT"]
# Other names under which ratios find a concept that is missing.
OTHER_NAMES = {"DEBT_TOTAL": "LIABILITIES_ALL", "PROFIT_NET": "PROFIT_AFTER_TAX", "PROFIT_OPERATING": "EARNINGS_BEFORE_INTEREST_TAX"}
CONCEPTS = sorted(
    {x for r in RULES for x in (r.left, *(c for c, *_ in r.terms))} | {x for _, _, up, down in RATIOS for x in (down, *(c for c, _ in up))}
    | {*FLOW_INDIRECT, *FLOW_DIRECT, *FLOW_INVESTED, *SCORE_OPTIONAL, *OTHER_NAMES.values()}
)


def current(facts: DataFrame) -> DataFrame:
    """The facts of the current period: marked so, or whose period is the year of the report."""
    return facts.where((F.col("period_type") == "current") | (F.col("period") == F.col("year").cast("string"))).withColumn("period_type", F.lit("current"))


def wide(chosen: DataFrame, period: str = "current") -> DataFrame:
    """A row per document with a column of values and one of fact numbers for each concept of the rules, and whether its deferred tax is a benefit."""
    c = chosen.where((F.col("period_type") == period) & F.col("concept").isin(CONCEPTS))
    one = lambda x, v: F.max(F.when(F.col("concept") == x, v))
    benefit = one("TAX_DEFERRED", F.lower("raw_label").rlike(BENEFIT))
    return c.groupBy("doc_id").agg(*[one(x, F.col("value")).alias(x) for x in CONCEPTS], *[one(x, F.col("seq")).alias(f"{x}__seq") for x in CONCEPTS], F.coalesce(benefit, F.lit(False)).alias("_benefit"))


def _value(c: str, size: bool = False) -> Column:
    v = F.coalesce(F.col(c), F.lit(0.0))
    return F.abs(v) if size else v


def _total(terms: list[tuple[str, int, bool]]) -> Column:
    return reduce(lambda a, b: a + b, [_value(c, size) if sign > 0 else -_value(c, size) for c, sign, size in terms])


def _there(concepts: list[str]) -> Column:
    """How many of some concepts are there."""
    return sum((F.col(c).isNotNull().cast("int") for c in concepts), F.lit(0))


def signed(w: DataFrame) -> DataFrame:
    """Wide rows with the signs of cash flows repaired, and what was done.

    A flow of operations (three parts or more, the indirect ones before the direct) or of investment takes
    the sum of its parts when they agree in size. A flow of financing turns negative when that agrees with
    its parts. Change and flows then take the first signs under which they add up: as they are, the change
    negative, the change positive, any combination; a flow of financing that its parts confirm is not turned.
    """
    same = lambda a, b: approx_equal(F.abs(F.col(a)), F.abs(b))
    plain = lambda concepts: _total(_plus(*concepts))
    indirect, direct = _there(FLOW_INDIRECT) >= 3, _there(FLOW_DIRECT) >= 3
    parts = F.when(indirect, plain(FLOW_INDIRECT)).when(direct, plain(FLOW_DIRECT))
    w = w.withColumn("FLOW_OPERATING", F.when(parts.isNotNull() & same("FLOW_OPERATING", parts), parts).otherwise(F.col("FLOW_OPERATING")))
    parts = plain(FLOW_INVESTED)
    w = w.withColumn("FLOW_INVESTING", F.when((_there(FLOW_INVESTED) > 0) & same("FLOW_INVESTING", parts), parts).otherwise(F.col("FLOW_INVESTING")))
    financed, v = _total(RULES[12].terms), F.col("FLOW_FINANCING")
    w = w.withColumn("FLOW_FINANCING", F.when((_there(FLOW_FINANCED) > 0) & ~approx_equal(v, financed) & approx_equal(-F.abs(v), financed), -F.abs(v)).otherwise(v))
    w = w.withColumn("_financed", F.coalesce((_there(FLOW_FINANCED) > 0) & approx_equal(v, financed), F.lit(False)))
    o, i, f, n = (F.col(c) for c in (*FLOWS, "FLOW_NET"))
    ways = [(F.lit(True), o, i, f, x) for x in (n, -F.abs(n), F.abs(n))]
    ways += [(~F.col("_financed") if z < 0 else F.lit(True), x * o, y * i, z * f, t * n) for x, y, z, t in itertools.product((1, -1), repeat=4)]
    there = _there([*FLOWS, "FLOW_NET"]) == 4
    solved = F.coalesce(*[F.when(there & may & approx_equal(a + b + c, d), F.struct(*(x.alias(k) for x, k in zip((a, b, c, d), (*FLOWS, "FLOW_NET"), strict=True)))) for may, a, b, c, d in ways])
    w = w.withColumn("_solved", solved)
    return w.select(*[F.coalesce(F.col(f"_solved.{c}"), F.col(c)).alias(c) if c in (*FLOWS, "FLOW_NET") else F.col(c) for c in w.columns])


def checked(w: DataFrame) -> DataFrame:
    """(doc_id, check_id, name, actual, expected, delta, passed): the identities whose facts are there and that are not silent; delta is by size."""
    w = signed(w)
    rows = []
    for r in RULES:
        left, expected = F.col(r.left), _total(r.terms)
        ok = _there([r.left, *r.all_of]) == 1 + len(r.all_of)
        if r.any_of:
            ok = ok & (_there(r.any_of) > 0)
        if r.id == 12:  # a deferred tax adds when its label says so, or when the sum then agrees
            with_benefit = expected + 2 * _value("TAX_DEFERRED", True)
            expected = F.when(F.col("_benefit") | approx_equal(left, with_benefit), with_benefit).otherwise(expected)
        passed, delta = approx_equal(left, expected), F.abs(left - expected)
        if r.id == 14:
            passed = F.col("_solved").isNotNull()
        if r.id == 15:  # the change, the exchange difference or both may have lost their sign
            opening, change, exchange = _value("FLOW_OPENING"), _value("FLOW_NET"), _value("FLOW_EXCHANGE")
            others = [opening + change - F.abs(exchange), opening - F.abs(change) + exchange, opening - F.abs(change) - F.abs(exchange)]
            passed = reduce(lambda a, b: a | b, [approx_equal(left, x) for x in (expected, *others)])
            delta = F.least(delta, F.abs(left - others[0]))
            ok = ok & (passed | (delta > F.greatest(F.lit(2.0), 0.01 * F.abs(left))))
        if r.silent:
            ok = ok & (passed | (_there(r.any_of) >= 3) | (delta > 0.05 * F.abs(left)))
        rows.append(F.when(ok, F.struct(F.lit(r.id).alias("check_id"), F.lit(r.name).alias("name"), left.alias("actual"), expected.alias("expected"), delta.alias("delta"), passed.alias("passed"))))
    return w.select("doc_id", F.explode(F.array_compact(F.array(*rows))).alias("c")).select("doc_id", "c.*")


def repairs(w: DataFrame) -> DataFrame:
    """(doc_id, concept, seq, value, repaired): the facts whose value the repair of signs changes."""
    after = signed(w).select("doc_id", *[F.col(c).alias(f"_{c}") for c in (*FLOWS, "FLOW_NET")])
    both = w.join(after, "doc_id")
    rows = [F.when(F.col(c) != F.col(f"_{c}"), F.struct(F.lit(c).alias("concept"), F.col(f"{c}__seq").alias("seq"), F.col(c).alias("value"), F.col(f"_{c}").alias("repaired"))) for c in (*FLOWS, "FLOW_NET")]
    return both.select("doc_id", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("doc_id", "r.*")


def _fixed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed list as a table."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def statuses(checks: DataFrame, chosen: DataFrame) -> DataFrame:
    """Status of each fact that a check sets one for: that of the check with the highest number."""
    rows = [(r.id, c, True) for r in RULES for c in r.verified] + [(r.id, c, False) for r in RULES for c in r.blamed]
    touched = checks.join(_fixed(checks.sparkSession, rows, "check_id int, concept string, passed boolean"), ["check_id", "passed"])
    s = touched.groupBy("doc_id", "concept").agg(F.max_by(F.when(F.col("passed"), "VERIFIED").otherwise("DISCREPANCY"), "check_id").alias("status"), F.count("*").alias("checks"))
    return s.join(chosen.where("period_type = 'current'").select("doc_id", "concept", "seq"), ["doc_id", "concept"])


def reports(checks: DataFrame) -> DataFrame:
    """Per document: checks, passed, failed, failed ids in order, total residual, whether all balance."""
    return checks.groupBy("doc_id").agg(
        F.count("*").alias("checks"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
        F.array_join(F.transform(F.sort_array(F.collect_set(F.when(~F.col("passed"), F.col("check_id")))), lambda x: x.cast("string")), ",").alias("failed_ids"),
        F.sum(F.when(~F.col("passed"), F.col("delta")).otherwise(0.0).cast("decimal(38,2)")).cast("double").alias("residual"), F.bool_and("passed").alias("balanced"),
    )


def suspects(checks: DataFrame, facts: DataFrame, top: int = 5) -> DataFrame:
    """The facts most likely wrong in each document that does not balance, the best `top`.

    10 for each failed check a concept is in; less what passed checks clear. When closing cash and cash in
    the balance differ, the side that its own statement confirms is cleared by 20 and the other gains 15.
    Equal scores rank in the order in which failed checks name the concepts. The fact is the first one of
    the concept in `facts`, whatever its priority.
    """
    rows = [(r.id, False, c, 10, r.id * 100 + k) for r in RULES for k, c in enumerate([r.left, *(c for c, *_ in r.terms)])]
    rows += [(i, True, c, -n, 1 << 20) for i, many in CLEARED.items() for c, n in many.items()]
    points = checks.join(_fixed(checks.sparkSession, rows, "check_id int, passed boolean, concept string, points int, place int"), ["check_id", "passed"]).select("doc_id", "concept", "points", "place")
    state = lambda i, passed: F.bool_or((F.col("check_id") == i) & (F.col("passed") == passed))
    cash = checks.groupBy("doc_id").agg(state(16, False).alias("differ"), state(3, True).alias("balance"), state(15, True).alias("flow")).where("differ and (balance or flow)")
    moved = lambda c, right: F.struct(F.lit(c).alias("concept"), F.when(right, -20).otherwise(15).alias("points"))
    cash = cash.select("doc_id", F.explode(F.array(moved("CASH_POOL", F.col("balance")), moved("FLOW_CLOSING", ~F.col("balance")))).alias("m")).select("doc_id", "m.*", F.lit(1 << 20).alias("place"))
    s = points.unionByName(cash).groupBy("doc_id", "concept").agg(F.sum("points").alias("score"), F.min("place").alias("place")).where("score > 0")
    first = current(facts).where("concept is not null and value is not null").groupBy("doc_id", "concept").agg(F.min("seq").alias("seq"))
    w = W.partitionBy("doc_id").orderBy(F.desc("score"), "place")
    return s.join(first, ["doc_id", "concept"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("doc_id", "rank", "concept", "seq", "score")


def ratios(w: DataFrame) -> DataFrame:
    """(doc_id, ratio, category, value, inputs): the ratios whose facts are there, under their own or their other name, with the numbers of those facts."""
    for c, other in OTHER_NAMES.items():
        w = w.withColumn(f"{c}__seq", F.coalesce(F.when(F.col(c).isNotNull(), F.col(f"{c}__seq")), F.col(f"{other}__seq"))).withColumn(c, F.coalesce(c, other))
    rows = []
    for name, category, up, down in RATIOS:
        ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (down, *(c for c, _ in up))]) & (F.col(down) > 0)
        inputs = F.array(*[F.col(f"{c}__seq") for c in (*(c for c, _ in up), down)])
        rows.append(F.when(ok, F.struct(F.lit(name).alias("ratio"), F.lit(category).alias("category"), ratio(reduce(lambda a, b: a + b, [F.col(c) * s for c, s in up]), F.col(down)).alias("value"), F.array_join(inputs.cast("array<string>"), ",").alias("inputs"))))
    needed = sorted({c for _, up, down in SCORE for c in (down, *(c for c, _ in up))} - set(SCORE_OPTIONAL))
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in needed]) & (F.col("ASSETS_TOTAL") > 0) & (F.col("DEBT_TOTAL") > 0)
    z = reduce(lambda a, b: a + b, [k * reduce(lambda a, b: a + b, [_value(c) * s for c, s in up]) / F.nullif(F.col(down), F.lit(0.0)) for k, up, down in SCORE])
    inputs = F.array_compact(F.array(*[F.col(f"{c}__seq").cast("string") for c in (*needed, *SCORE_OPTIONAL)]))
    rows.append(F.when(ok, F.struct(F.lit("distress_score").alias("ratio"), F.lit("health").alias("category"), F.round(z, 4).alias("value"), F.array_join(inputs, ",").alias("inputs"))))
    return w.select("doc_id", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("doc_id", "r.*")


def what_if(chosen: DataFrame, proposals: DataFrame) -> DataFrame:
    """(doc_id, concept, accepted, failed_before, failed_after, residual_before, residual_after) of proposed values, each tried alone against the checks of its document.

    proposals: doc_id, concept, value. Accepted when nothing fails any more, fewer checks fail, or no
    more fail and the residual falls by more than 2.
    """
    base = reports(checked(wide(chosen))).select("doc_id", F.col("failed").alias("failed_before"), F.col("residual").alias("residual_before"))
    p = proposals.where("value is not null").groupBy("doc_id", "concept").agg(F.max("value").alias("_new"))
    tried = p.join(chosen.withColumnRenamed("concept", "_c"), "doc_id").withColumn("value", F.when(F.col("_c") == F.col("concept"), F.col("_new")).otherwise(F.col("value")))
    tried = tried.withColumn("doc_id", F.concat_ws("\x1f", "doc_id", "concept")).drop("concept").withColumnRenamed("_c", "concept")
    after = reports(checked(wide(tried))).select(F.split("doc_id", "\x1f").alias("_k"), F.col("failed").alias("failed_after"), F.col("residual").alias("residual_after"))
    out = after.select(F.get("_k", F.lit(0)).alias("doc_id"), F.get("_k", F.lit(1)).alias("concept"), "failed_after", "residual_after").join(base, "doc_id")
    ok = (F.col("failed_after") == 0) | (F.col("failed_after") < F.col("failed_before")) | ((F.col("failed_after") <= F.col("failed_before")) & (F.col("residual_before") - F.col("residual_after") > 2.0))
    return out.withColumn("accepted", ok)


def corrected(chosen: DataFrame, proposals: DataFrame, attempts: int = 5) -> DataFrame:
    """chosen after up to `attempts` rounds: in each, a document's next proposal by rank is tried against the values so far, and stays if accepted.

    proposals: doc_id, rank, concept, value.
    """
    for k in range(1, attempts + 1):
        p = proposals.where(F.col("rank") == k).select("doc_id", "concept", "value")
        good = what_if(chosen, p).where("accepted").select("doc_id", "concept")
        new = p.join(good, ["doc_id", "concept"]).select("doc_id", "concept", F.lit("current").alias("period_type"), F.col("value").alias("_new"))
        chosen = chosen.join(new, ["doc_id", "concept", "period_type"], "left").withColumn("value", F.coalesce("_new", "value")).drop("_new")
    return chosen


# ---- Queries ----------------------------------------------------------------------------------------


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "financial_facts")


def _chosen(spark: SparkSession, d: str) -> DataFrame:
    return winners(current(_facts(spark, d)), table(spark, d, "concept_definitions"))


def audit_checks(spark: SparkSession, d: str) -> DataFrame:
    return checked(wide(_chosen(spark, d))).select("doc_id", "check_id", "name", "actual", F.round("expected", 1).alias("expected"), F.round("delta", 1).alias("delta"), "passed")


def audit_statuses(spark: SparkSession, d: str) -> DataFrame:
    c = _chosen(spark, d)
    return statuses(checked(wide(c)), c).select("doc_id", "concept", "seq", "status", "checks")


def audit_reports(spark: SparkSession, d: str) -> DataFrame:
    return reports(checked(wide(_chosen(spark, d))))


def audit_repairs(spark: SparkSession, d: str) -> DataFrame:
    return repairs(wide(_chosen(spark, d)))


def audit_suspects(spark: SparkSession, d: str) -> DataFrame:
    return suspects(checked(wide(_chosen(spark, d))), _facts(spark, d))


def statement_ratios(spark: SparkSession, d: str) -> DataFrame:
    return ratios(wide(_chosen(spark, d)))


def correction_trials(spark: SparkSession, d: str) -> DataFrame:
    """Each suspect's value with its sign turned, tried against the checks."""
    c = _chosen(spark, d)
    s = suspects(checked(wide(c)), _facts(spark, d)).drop("seq").join(c.where("period_type = 'current'"), ["doc_id", "concept"])
    return what_if(c, s.select("doc_id", "concept", (-F.col("value")).alias("value"))).select("doc_id", "concept", "failed_before", "failed_after", "accepted")


QUERIES = {f.__name__: f for f in (audit_checks, audit_statuses, audit_reports, audit_repairs, audit_suspects, statement_ratios, correction_trials)}


# ---- SQL, written out check by check ----------------------------------------------------------------


def _eq(a: str, b: str) -> str:
    return f"(abs({a} - ({b})) <= 2 OR abs({a} - ({b})) <= 1e-4 * greatest(abs({a}), abs({b})))"


_COLUMNS = ", ".join(f"max(CASE WHEN concept = '{c}' THEN value END) AS {c}, max(CASE WHEN concept = '{c}' THEN seq END) AS {c}__seq" for c in CONCEPTS)
_WINNERS = f"""cw AS (SELECT doc_id, 'current' AS period_type, concept, seq, value, raw_label FROM (
  SELECT f.*, {PRIORITY} AS priority FROM financial_facts f JOIN concept_definitions c USING (concept) WHERE value IS NOT NULL AND (period_type = 'current' OR period = year::VARCHAR))
  QUALIFY row_number() OVER (PARTITION BY doc_id, concept ORDER BY priority DESC, seq) = 1),
wide0 AS (SELECT doc_id, {_COLUMNS}, coalesce(max(CASE WHEN concept = 'TAX_DEFERRED' THEN regexp_matches(lower(raw_label), '{BENEFIT}') END), false) AS benefit FROM cw GROUP BY doc_id)"""


def _z(*concepts: str) -> str:
    return " + ".join(f"coalesce({c}, 0)" for c in concepts)


def _n(*concepts: str) -> str:
    return "(" + " + ".join(f"({c} IS NOT NULL)::INT" for c in concepts) + ")"


_FINANCED = "abs(coalesce(FLOW_EQUITY_IN, 0)) - abs(coalesce(FLOW_CAPITAL_BACK, 0)) + abs(coalesce(FLOW_LOAN_IN, 0)) - abs(coalesce(FLOW_LOAN_OUT, 0)) - abs(coalesce(FLOW_LEASE_OUT, 0)) - abs(coalesce(FLOW_DIVIDEND, 0))"
_C = f"""{_WINNERS},
w1 AS (SELECT * REPLACE (
  CASE WHEN {_n(*FLOW_INDIRECT)} >= 3 AND {_eq('abs(FLOW_OPERATING)', f'abs({_z(*FLOW_INDIRECT)})')} THEN {_z(*FLOW_INDIRECT)}
    WHEN {_n(*FLOW_INDIRECT)} < 3 AND {_n(*FLOW_DIRECT)} >= 3 AND {_eq('abs(FLOW_OPERATING)', f'abs({_z(*FLOW_DIRECT)})')} THEN {_z(*FLOW_DIRECT)} ELSE FLOW_OPERATING END AS FLOW_OPERATING,
  CASE WHEN {_n(*FLOW_INVESTED)} >= 1 AND {_eq('abs(FLOW_INVESTING)', f'abs({_z(*FLOW_INVESTED)})')} THEN {_z(*FLOW_INVESTED)} ELSE FLOW_INVESTING END AS FLOW_INVESTING,
  CASE WHEN {_n(*FLOW_FINANCED)} >= 1 AND NOT {_eq('FLOW_FINANCING', _FINANCED)} AND {_eq('-abs(FLOW_FINANCING)', _FINANCED)} THEN -abs(FLOW_FINANCING) ELSE FLOW_FINANCING END AS FLOW_FINANCING) FROM wide0),
w2 AS (SELECT *, coalesce(FLOW_FINANCING IS NOT NULL AND {_n(*FLOW_FINANCED)} >= 1 AND {_eq('FLOW_FINANCING', _FINANCED)}, false) AS sure FROM w1),
way(k, o, i, f, n, m) AS (VALUES (1, 1, 1, 1, 1, 0), (2, 1, 1, 1, -1, 1), (3, 1, 1, 1, 1, 1), {', '.join(f'({4 + k}, {o}, {i}, {f}, {n}, 0)' for k, (o, i, f, n) in enumerate(itertools.product((1, -1), repeat=4)))}),
tried AS (SELECT doc_id, k, o * FLOW_OPERATING AS o, i * FLOW_INVESTING AS i, f * FLOW_FINANCING AS f, n * CASE WHEN m = 1 THEN abs(FLOW_NET) ELSE FLOW_NET END AS n FROM w2, way WHERE NOT (f < 0 AND sure)),
solved AS (SELECT doc_id, arg_min(o, k) AS o, arg_min(i, k) AS i, arg_min(f, k) AS f, arg_min(n, k) AS n FROM tried WHERE {_eq('n', 'o + i + f')} AND o + i + f + n IS NOT NULL GROUP BY doc_id),
wide AS (SELECT w2.* REPLACE (coalesce(s.o, FLOW_OPERATING) AS FLOW_OPERATING, coalesce(s.i, FLOW_INVESTING) AS FLOW_INVESTING, coalesce(s.f, FLOW_FINANCING) AS FLOW_FINANCING, coalesce(s.n, FLOW_NET) AS FLOW_NET), s.doc_id IS NOT NULL AS solved FROM w2 LEFT JOIN solved s USING (doc_id)),
raw AS (
  SELECT doc_id, 1 AS check_id, 'assets = sources' AS name, ASSETS_TOTAL AS actual, SOURCES_TOTAL AS expected, 0 AS parts FROM wide WHERE SOURCES_TOTAL IS NOT NULL
  UNION ALL SELECT doc_id, 2, 'assets = short + long', ASSETS_TOTAL, ASSETS_SHORT + ASSETS_LONG, 0 FROM wide
  UNION ALL SELECT doc_id, 3, 'short assets = parts', ASSETS_SHORT, {_z(*PARTS_SHORT)}, {_n(*PARTS_SHORT)} FROM wide WHERE {_n(*PARTS_SHORT)} >= 1
  UNION ALL SELECT doc_id, 4, 'long assets = parts', ASSETS_LONG, {_z(*PARTS_LONG)}, {_n(*PARTS_LONG)} FROM wide WHERE {_n(*PARTS_LONG)} >= 1
  UNION ALL SELECT doc_id, 5, 'sources = debt + equity', SOURCES_TOTAL, DEBT_TOTAL + EQUITY_TOTAL, 0 FROM wide
  UNION ALL SELECT doc_id, 6, 'debt = short + long', DEBT_TOTAL, {_z('DEBT_SHORT', 'DEBT_LONG')}, 0 FROM wide WHERE coalesce(DEBT_SHORT, DEBT_LONG) IS NOT NULL
  UNION ALL SELECT doc_id, 7, 'net revenue = gross - cuts', REVENUE_NET, REVENUE_GROSS - abs(REVENUE_CUT), 0 FROM wide
  UNION ALL SELECT doc_id, 8, 'gross profit = net revenue - cost', PROFIT_GROSS, REVENUE_NET - abs(COST_SALES), 0 FROM wide
  UNION ALL SELECT doc_id, 9, 'operating profit', PROFIT_OPERATING, PROFIT_GROSS + abs(coalesce(INCOME_FINANCE, 0)) - abs(coalesce(COST_FINANCE, 0)) - abs(coalesce(COST_SELLING, 0)) - abs(coalesce(COST_ADMIN, 0)), 0 FROM wide WHERE coalesce(INCOME_FINANCE, COST_FINANCE, COST_SELLING, COST_ADMIN) IS NOT NULL
  UNION ALL SELECT doc_id, 10, 'other profit', PROFIT_OTHER, abs(coalesce(INCOME_OTHER, 0)) - abs(coalesce(COST_OTHER, 0)), 0 FROM wide WHERE coalesce(INCOME_OTHER, COST_OTHER) IS NOT NULL
  UNION ALL SELECT doc_id, 11, 'profit before tax', PROFIT_PRETAX, PROFIT_OPERATING + PROFIT_OTHER, 0 FROM wide
  UNION ALL SELECT doc_id, 12, 'profit after tax', PROFIT_NET, CASE WHEN benefit OR {_eq('PROFIT_NET', 'PROFIT_PRETAX - abs(coalesce(TAX_CURRENT, 0)) + abs(coalesce(TAX_DEFERRED, 0))')} THEN PROFIT_PRETAX - abs(coalesce(TAX_CURRENT, 0)) + abs(coalesce(TAX_DEFERRED, 0)) ELSE PROFIT_PRETAX - abs(coalesce(TAX_CURRENT, 0)) - abs(coalesce(TAX_DEFERRED, 0)) END, 0 FROM wide WHERE coalesce(TAX_CURRENT, TAX_DEFERRED) IS NOT NULL
  UNION ALL SELECT doc_id, 13, 'flow of financing = parts', FLOW_FINANCING, {_FINANCED}, 0 FROM wide WHERE {_n(*FLOW_FINANCED)} >= 1
  UNION ALL SELECT doc_id, 14, 'change of cash = three flows', FLOW_NET, FLOW_OPERATING + FLOW_INVESTING + FLOW_FINANCING, 0 FROM wide
  UNION ALL SELECT doc_id, 15, 'closing cash = opening + change', FLOW_CLOSING, FLOW_OPENING + FLOW_NET + coalesce(FLOW_EXCHANGE, 0), 0 FROM wide
  UNION ALL SELECT doc_id, 16, 'closing cash = cash in the balance', FLOW_CLOSING, CASH_POOL, 0 FROM wide
  UNION ALL SELECT doc_id, 17, 'profit before tax in both statements', FLOW_PRETAX, PROFIT_PRETAX, 0 FROM wide),
judged AS (SELECT r.*, CASE check_id WHEN 14 THEN solved
    WHEN 15 THEN {_eq('actual', 'expected')} OR {_eq('actual', 'FLOW_OPENING + FLOW_NET - abs(coalesce(FLOW_EXCHANGE, 0))')} OR {_eq('actual', 'FLOW_OPENING - abs(FLOW_NET) + coalesce(FLOW_EXCHANGE, 0)')} OR {_eq('actual', 'FLOW_OPENING - abs(FLOW_NET) - abs(coalesce(FLOW_EXCHANGE, 0))')}
    ELSE {_eq('actual', 'expected')} END AS passed,
  CASE check_id WHEN 15 THEN least(abs(actual - expected), abs(actual - (FLOW_OPENING + FLOW_NET - abs(coalesce(FLOW_EXCHANGE, 0))))) ELSE abs(actual - expected) END AS delta
  FROM raw r JOIN wide USING (doc_id) WHERE actual IS NOT NULL AND expected IS NOT NULL),
ch AS (SELECT doc_id, check_id, name, actual, expected, delta, passed FROM judged WHERE passed OR NOT (check_id IN (3, 4) AND parts < 3 AND delta <= 0.05 * abs(actual)) AND NOT (check_id = 15 AND delta <= greatest(2, 0.01 * abs(actual))))"""
_MARKS = """mark(check_id, passed, concept) AS (VALUES
  (1, true, 'ASSETS_TOTAL'), (1, true, 'SOURCES_TOTAL'), (1, false, 'ASSETS_TOTAL'), (1, false, 'SOURCES_TOTAL'), (2, true, 'ASSETS_SHORT'), (2, true, 'ASSETS_LONG'), (2, false, 'ASSETS_SHORT'), (2, false, 'ASSETS_LONG'),
  (3, false, 'ASSETS_SHORT'), (3, true, 'ASSETS_SHORT'), (3, true, 'CASH_POOL'), (3, true, 'DEPOSIT_SHORT'), (3, true, 'RECV_CUSTOMER_SHORT'), (3, true, 'STOCK_NET'), (3, true, 'PREPAID_SHORT'),
  (4, false, 'ASSETS_LONG'), (4, true, 'ASSETS_LONG'), (4, true, 'RECV_CUSTOMER_LONG'), (4, true, 'FIXED_TANGIBLE_COST'), (4, true, 'RENTAL_PROPERTY'), (4, true, 'BUILD_IN_PROGRESS'), (4, true, 'DEPOSIT_LONG'), (4, true, 'PREPAID_LONG'),
  (5, true, 'DEBT_TOTAL'), (5, true, 'EQUITY_TOTAL'), (5, false, 'DEBT_TOTAL'), (5, false, 'EQUITY_TOTAL'), (6, true, 'DEBT_TOTAL'), (6, true, 'DEBT_SHORT'), (6, true, 'DEBT_LONG'), (6, false, 'DEBT_TOTAL'),
  (7, true, 'REVENUE_NET'), (7, true, 'REVENUE_GROSS'), (7, false, 'REVENUE_NET'), (8, true, 'PROFIT_GROSS'), (8, true, 'REVENUE_NET'), (8, true, 'COST_SALES'), (9, true, 'PROFIT_OPERATING'), (9, false, 'PROFIT_OPERATING'),
  (10, true, 'PROFIT_OTHER'), (10, false, 'PROFIT_OTHER'), (11, true, 'PROFIT_PRETAX'), (11, true, 'PROFIT_OPERATING'), (11, true, 'PROFIT_OTHER'), (11, false, 'PROFIT_PRETAX'), (12, true, 'PROFIT_NET'), (12, false, 'PROFIT_NET'),
  (13, true, 'FLOW_FINANCING'), (13, false, 'FLOW_FINANCING'), (14, true, 'FLOW_NET'), (14, true, 'FLOW_OPERATING'), (14, true, 'FLOW_INVESTING'), (14, true, 'FLOW_FINANCING'), (14, false, 'FLOW_NET'),
  (15, true, 'FLOW_CLOSING'), (15, false, 'FLOW_CLOSING'), (16, true, 'FLOW_CLOSING'), (16, true, 'CASH_POOL'), (16, false, 'FLOW_CLOSING'), (16, false, 'CASH_POOL'), (17, true, 'FLOW_PRETAX'), (17, true, 'PROFIT_PRETAX'), (17, false, 'FLOW_PRETAX'), (17, false, 'PROFIT_PRETAX'))"""
_POINTS = ", ".join([f"({r.id}, false, '{c}', 10, {r.id * 100 + k})" for r in RULES for k, c in enumerate([r.left, *(c for c, *_ in r.terms)])] + [f"({i}, true, '{c}', {-n}, 1048576)" for i, many in CLEARED.items() for c, n in many.items()])


def _sql_ratios() -> str:
    other = ", ".join(f"coalesce({c}, {o}) AS {c}, CASE WHEN {c} IS NOT NULL THEN {c}__seq ELSE {o}__seq END AS {c}__seq" for c, o in OTHER_NAMES.items())
    rw = f"(SELECT * REPLACE ({other}) FROM wide0)"
    parts = [
        f"SELECT doc_id, '{name}' AS ratio, '{category}' AS category, round(({' + '.join(f'{s} * {c}' for c, s in up)}) / {down}, 4) AS value, concat_ws(',', {', '.join(f'{c}__seq' for c in (*(c for c, _ in up), down))}) AS inputs FROM {rw} WHERE {down} > 0 AND {' AND '.join(f'{c} IS NOT NULL' for c, _ in up)}"
        for name, category, up, down in RATIOS
    ]
    needed = ["ASSETS_SHORT", "ASSETS_TOTAL", "DEBT_SHORT", "DEBT_TOTAL", "EQUITY_TOTAL", "PROFIT_OPERATING", "REVENUE_NET"]
    z = "0.717 * (ASSETS_SHORT - DEBT_SHORT) / ASSETS_TOTAL + 0.847 * coalesce(PROFIT_KEPT, 0) / ASSETS_TOTAL + 3.107 * PROFIT_OPERATING / ASSETS_TOTAL + 0.420 * EQUITY_TOTAL / DEBT_TOTAL + 0.998 * REVENUE_NET / ASSETS_TOTAL"
    parts.append(f"SELECT doc_id, 'distress_score', 'health', round({z}, 4), concat_ws(',', {', '.join(f'{c}__seq' for c in (*needed, 'PROFIT_KEPT'))}) FROM {rw} WHERE ASSETS_TOTAL > 0 AND DEBT_TOTAL > 0 AND {' AND '.join(f'{c} IS NOT NULL' for c in needed)}")
    return " UNION ALL ".join(parts)


ORACLES = {
    "audit_checks": f"WITH {_C} SELECT doc_id, check_id, name, actual, round(expected, 1) AS expected, round(delta, 1) AS delta, passed FROM ch",
    "audit_statuses": f"WITH {_C}, {_MARKS}, s AS (SELECT doc_id, concept, arg_max(CASE WHEN passed THEN 'VERIFIED' ELSE 'DISCREPANCY' END, check_id) AS status, count(*) AS checks FROM ch JOIN mark USING (check_id, passed) GROUP BY ALL) SELECT s.doc_id, s.concept, cw.seq, status, checks FROM s JOIN cw USING (doc_id, concept)",
    "audit_reports": f"WITH {_C} SELECT doc_id, count(*) AS checks, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed, coalesce(string_agg(check_id::VARCHAR, ',' ORDER BY check_id) FILTER (WHERE NOT passed), '') AS failed_ids, sum(CASE WHEN passed THEN 0 ELSE delta END::DECIMAL(38,2))::DOUBLE AS residual, bool_and(passed) AS balanced FROM ch GROUP BY doc_id",
    "audit_repairs": f"WITH {_C} " + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS concept, a.{c}__seq AS seq, a.{c} AS value, b.{c} AS repaired FROM wide0 a JOIN wide b USING (doc_id) WHERE a.{c} <> b.{c}" for c in (*FLOWS, "FLOW_NET")),
    "audit_suspects": f"""WITH {_C}, point(check_id, passed, concept, points, place) AS (VALUES {_POINTS}),
cash AS (SELECT doc_id, bool_or(check_id = 16 AND NOT passed) AS differ, bool_or(check_id = 3 AND passed) AS balance, bool_or(check_id = 15 AND passed) AS flow FROM ch GROUP BY doc_id),
p AS (SELECT doc_id, concept, points, place FROM ch JOIN point USING (check_id, passed)
  UNION ALL SELECT doc_id, 'CASH_POOL', CASE WHEN balance THEN -20 ELSE 15 END, 1048576 FROM cash WHERE differ AND (balance OR flow)
  UNION ALL SELECT doc_id, 'FLOW_CLOSING', CASE WHEN balance THEN 15 ELSE -20 END, 1048576 FROM cash WHERE differ AND (balance OR flow)),
s AS (SELECT doc_id, concept, sum(points)::BIGINT AS score, min(place) AS place FROM p GROUP BY ALL HAVING sum(points) > 0),
first AS (SELECT doc_id, concept, min(seq) AS seq FROM financial_facts WHERE (period_type = 'current' OR period = year::VARCHAR) AND value IS NOT NULL AND concept IS NOT NULL GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place)::INT AS rank, concept, seq, score FROM s JOIN first USING (doc_id, concept) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) <= 5""",
    "statement_ratios": f"WITH {_WINNERS} {_sql_ratios()}",
}
