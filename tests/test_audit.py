"""Checks, statuses, repairs and suspects on made facts; expected values follow the rule list by hand, not the code."""

import pytest

from ledgerloom.operators import audit, facts

FACTS = "seq long, doc_id string, period_type string, concept string, raw_label string, value double, standard_code string, period string, year int"


def rows_of(docs):
    out = []
    for d, values in docs.items():
        for c, v in values.items():
            label = None
            if isinstance(v, tuple):
                v, label = v
            out.append((len(out) + 1, d, "current", c, label, float(v), None, "2020", 2020))
    return out


@pytest.fixture(scope="module")
def judge(spark):
    def run(docs):
        stored = spark.createDataFrame(rows_of(docs), FACTS)
        concepts = spark.createDataFrame([(c, None) for c in audit.CONCEPTS], "concept string, code string")
        chosen = facts.winners(audit.current(stored), concepts)
        checks = audit.checked(audit.wide(chosen))
        passed = {(r.doc_id, r.check_id): r.passed for r in checks.collect()}
        status = {(r.doc_id, r.concept): r.status for r in audit.statuses(checks, chosen).collect()}
        return chosen, checks, stored, passed, status

    return run


V, D = "VERIFIED", "DISCREPANCY"


def test_balance_and_income(judge):
    docs = {
        "whole": {"ASSETS_TOTAL": 1000, "SOURCES_TOTAL": 1000, "ASSETS_SHORT": 600, "ASSETS_LONG": 400, "DEBT_TOTAL": 700, "EQUITY_TOTAL": 300, "DEBT_SHORT": 700},
        "apart": {"ASSETS_TOTAL": 1000, "SOURCES_TOTAL": 950, "ASSETS_SHORT": 500, "ASSETS_LONG": 400, "DEBT_TOTAL": 700, "EQUITY_TOTAL": 300, "DEBT_LONG": 100},
        "parts": {"ASSETS_SHORT": 500, "CASH_POOL": 100, "STOCK_NET": 200, "PREPAID_SHORT": 200, "ASSETS_LONG": 1000, "PREPAID_LONG": 970},
        "parts_off": {"ASSETS_SHORT": 500, "CASH_POOL": 100, "STOCK_NET": 200, "PREPAID_SHORT": 190, "ASSETS_LONG": 1000, "PREPAID_LONG": 900},
        "income": {"REVENUE_NET": 900, "REVENUE_GROSS": 1000, "REVENUE_CUT": -100, "PROFIT_GROSS": 400, "COST_SALES": -500, "PROFIT_OPERATING": 350, "INCOME_FINANCE": 50, "COST_SELLING": -100, "PROFIT_OTHER": 15, "INCOME_OTHER": 20, "COST_OTHER": -5, "PROFIT_PRETAX": 365, "TAX_CURRENT": -65, "PROFIT_NET": 300, "FLOW_PRETAX": 365},
        "income_off": {"REVENUE_NET": 900, "REVENUE_GROSS": 1000, "REVENUE_CUT": 50, "PROFIT_GROSS": 300, "COST_SALES": 500, "PROFIT_OPERATING": 1, "COST_ADMIN": 7, "PROFIT_OTHER": 15, "COST_OTHER": 5, "PROFIT_PRETAX": 99, "TAX_DEFERRED": 10, "PROFIT_NET": 200, "FLOW_PRETAX": 50},
    }
    _, _, _, passed, status = judge(docs)
    assert {k for k, p in passed.items() if p} == {("whole", 1), ("whole", 2), ("whole", 5), ("whole", 6), ("parts", 3), ("income", 7), ("income", 8), ("income", 9), ("income", 10), ("income", 11), ("income", 12), ("income", 17)}
    assert {k for k, p in passed.items() if not p} == {("apart", 1), ("apart", 2), ("apart", 5), ("apart", 6), ("parts_off", 3), ("parts_off", 4), *(("income_off", k) for k in (7, 8, 9, 10, 11, 12, 17))}
    assert ("parts", 4) not in passed  # one part, within 5 %: silent
    of = lambda d: {c: s for (x, c), s in status.items() if x == d}
    assert of("whole") == dict.fromkeys(docs["whole"], V)
    # A lower check's status gives way to a higher one's: the debt is blamed by 5, then by 6; the sources only by 1.
    assert of("apart") == {"ASSETS_TOTAL": D, "SOURCES_TOTAL": D, "ASSETS_SHORT": D, "ASSETS_LONG": D, "DEBT_TOTAL": D, "EQUITY_TOTAL": D}
    assert of("parts") == dict.fromkeys(["ASSETS_SHORT", "CASH_POOL", "STOCK_NET", "PREPAID_SHORT"], V)
    assert of("parts_off") == {"ASSETS_SHORT": D, "ASSETS_LONG": D}
    # Cuts are cleared by no check, other income and cost by none, taxes by none.
    assert of("income") == dict.fromkeys(["REVENUE_NET", "REVENUE_GROSS", "PROFIT_GROSS", "COST_SALES", "PROFIT_OPERATING", "PROFIT_OTHER", "PROFIT_PRETAX", "PROFIT_NET", "FLOW_PRETAX"], V)
    # A failed check 8 sets no status.
    assert of("income_off") == {"REVENUE_NET": D, "PROFIT_OPERATING": D, "PROFIT_OTHER": D, "PROFIT_PRETAX": D, "PROFIT_NET": D, "FLOW_PRETAX": D}


def test_deferred_tax(judge):
    docs = {
        "cost": {"PROFIT_NET": 70, "PROFIT_PRETAX": 100, "TAX_CURRENT": 20, "TAX_DEFERRED": (10, "chi phí thuế")},
        "benefit": {"PROFIT_NET": 90, "PROFIT_PRETAX": 100, "TAX_CURRENT": 20, "TAX_DEFERRED": (10, "thuế")},
        "named": {"PROFIT_NET": 70, "PROFIT_PRETAX": 100, "TAX_CURRENT": 20, "TAX_DEFERRED": (-10, "Lợi ích thuế hoãn lại")},
    }
    assert judge(docs)[3] == {("cost", 12): True, ("benefit", 12): True, ("named", 12): False}


def test_signs_of_flows(judge):
    flows = lambda o, i, f, n, **more: {"FLOW_OPERATING": o, "FLOW_INVESTING": i, "FLOW_FINANCING": f, "FLOW_NET": n} | more
    docs = {
        "fine": flows(100, -50, -20, 30, FLOW_OPENING=10, FLOW_CLOSING=40, CASH_POOL=40),
        "net": flows(-100, 50, 20, 30),
        "net_up": flows(100, -50, -20, -30),
        "parts": flows(80, 50, -20, 10, FLOW_RECEIVABLES=50, FLOW_STOCK=50, FLOW_TAX=-20, FLOW_CAPEX=-60, FLOW_DISPOSAL=10),
        "direct": flows(80, -50, -20, 10, FLOW_RECEIVABLES=1, DIRECT_SALES=-100, DIRECT_STAFF=10, DIRECT_TAX=10),
        "financing": flows(100, -50, 20, 30, FLOW_LOAN_OUT=20),
        "kept": flows(100, -50, 20, 30, FLOW_LOAN_IN=20),
        "mixed": flows(100, 50, 20, 30),
        "never": flows(100, 50, 20, 7),
    }
    chosen, checks, _, passed, status = judge(docs)
    got = {(r.doc_id, r.concept): r.repaired for r in audit.repairs(audit.wide(chosen)).collect()}
    # Combinations keep the sign of operations first, then of investment, then of financing; "kept": its parts confirm the flow of financing, so the others turn.
    assert got == {
        ("net", "FLOW_NET"): -30, ("net_up", "FLOW_NET"): 30, ("parts", "FLOW_INVESTING"): -50, ("financing", "FLOW_FINANCING"): -20, ("mixed", "FLOW_INVESTING"): -50, ("mixed", "FLOW_FINANCING"): -20,
        ("direct", "FLOW_OPERATING"): -80, ("direct", "FLOW_INVESTING"): 50, ("direct", "FLOW_FINANCING"): 20, ("direct", "FLOW_NET"): -10, ("kept", "FLOW_OPERATING"): -100, ("kept", "FLOW_INVESTING"): 50, ("kept", "FLOW_NET"): -30,
    }
    assert {d: passed.get((d, 14)) for d in docs} == {"fine": True, "net": True, "net_up": True, "parts": True, "direct": True, "financing": True, "kept": True, "mixed": True, "never": False}
    assert {d: passed.get((d, 13)) for d in ("financing", "kept", "fine")} == {"financing": True, "kept": True, "fine": None}
    assert status["never", "FLOW_NET"] == D and ("never", "FLOW_OPERATING") not in status
    assert [status["mixed", c] for c in ("FLOW_NET", "FLOW_OPERATING", "FLOW_INVESTING", "FLOW_FINANCING")] == [V] * 4
    assert passed["fine", 15] and passed["fine", 16] and status["fine", "CASH_POOL"] == V


def test_closing_cash(judge):
    docs = {
        "exchange": {"FLOW_CLOSING": 45, "FLOW_OPENING": 10, "FLOW_NET": 30, "FLOW_EXCHANGE": 5},
        "turned": {"FLOW_CLOSING": 35, "FLOW_OPENING": 10, "FLOW_NET": 30, "FLOW_EXCHANGE": 5},
        "lost": {"FLOW_CLOSING": 10, "FLOW_OPENING": 40, "FLOW_NET": 30},
        "silent": {"FLOW_CLOSING": 10_000, "FLOW_OPENING": 9_000, "FLOW_NET": 950},
        "off": {"FLOW_CLOSING": 10_000, "FLOW_OPENING": 9_000, "FLOW_NET": 100, "CASH_POOL": 5},
    }
    _, _, _, passed, status = judge(docs)
    assert passed == {("exchange", 15): True, ("turned", 15): True, ("lost", 15): True, ("off", 15): False, ("off", 16): False}
    assert status["off", "CASH_POOL"] == D and status["off", "FLOW_CLOSING"] == D


def test_suspects(judge):
    docs = {
        "sides": {"ASSETS_TOTAL": 1000, "ASSETS_SHORT": 600, "ASSETS_LONG": 400, "SOURCES_TOTAL": 1200, "DEBT_TOTAL": 700, "EQUITY_TOTAL": 400},
        "cash": {"ASSETS_SHORT": 500, "CASH_POOL": 100, "STOCK_NET": 200, "PREPAID_SHORT": 200, "FLOW_CLOSING": 90},
        "flow": {"CASH_POOL": 100, "FLOW_CLOSING": 90, "FLOW_OPENING": 50, "FLOW_NET": 40},
    }
    _, checks, stored, _, _ = judge(docs)
    got = [(r.doc_id, r.rank, r.concept, r.score) for r in audit.suspects(checks, stored).orderBy("doc_id", "rank").collect()]
    assert got == [
        ("cash", 1, "FLOW_CLOSING", 25),
        ("flow", 1, "CASH_POOL", 25),
        ("sides", 1, "SOURCES_TOTAL", 20), ("sides", 2, "DEBT_TOTAL", 10), ("sides", 3, "EQUITY_TOTAL", 10),
    ]


def test_correction_rounds(judge, spark):
    chosen, _, _, _, _ = judge({"d": {"ASSETS_TOTAL": 1000, "SOURCES_TOTAL": 1200, "DEBT_TOTAL": 700, "EQUITY_TOTAL": 300}})
    p = spark.createDataFrame([("d", 1, "ASSETS_TOTAL", 5.0), ("d", 2, "SOURCES_TOTAL", 1000.0)], "doc_id string, rank int, concept string, value double")
    assert {r.concept: r.value for r in audit.corrected(chosen, p, 2).collect()} == {"ASSETS_TOTAL": 1000.0, "SOURCES_TOTAL": 1000.0, "DEBT_TOTAL": 700.0, "EQUITY_TOTAL": 300.0}


def test_score_and_other_names(spark):
    v = {"ASSETS_SHORT": 100.0, "DEBT_SHORT": 50.0, "LIABILITIES_ALL": 80.0, "EQUITY_TOTAL": 120.0, "ASSETS_TOTAL": 200.0, "REVENUE_NET": 300.0, "EARNINGS_BEFORE_INTEREST_TAX": 45.0, "PROFIT_AFTER_TAX": 30.0, "PROFIT_KEPT": 40.0}
    chosen = spark.createDataFrame([("d", "current", c, k, x, None) for k, (c, x) in enumerate(v.items())], "doc_id string, period_type string, concept string, seq long, value double, raw_label string")
    got = {r.ratio: (r.value, r.inputs) for r in audit.ratios(audit.wide(chosen)).collect()}
    assert got["distress_score"] == (pytest.approx(0.717 * 0.25 + 0.847 * 0.2 + 3.107 * 0.225 + 0.42 * 1.5 + 0.998 * 1.5, abs=1e-4), "0,4,1,2,3,6,5,8")
    assert got["debt_to_equity"] == (0.6667, "2,3") and got["roa"] == (0.15, "7,4") and got["operating_margin"] == (0.15, "6,5")
