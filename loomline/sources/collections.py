"""The small stored collections, as typed tables in their stored order.

Numbers, enumerations and shapes are fixed values; prose is a placeholder of our own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import scalars as S
from loomline.sources.stores import collection

_SOURCE = ("register", "notice", "as stored")

# Id, source system, score, band, status, deadline.
_TENDERS = [
    ("T-2026-014", "eTenders", 91, "High", "New", "18 Sep 2026"),
    ("T-2026-021", "eTenders / TED", 84, "High", "Review", "5 Oct 2026"),
    ("T-2026-009", "OPW", 76, "Medium", "New", "30 Aug 2026"),
    ("T-2026-033", "Local Authority", 68, "Medium", "Review", "12 Sep 2026"),
    ("T-2026-041", "Direct", 58, "Low", "New", "25 Sep 2026"),
    ("T-2026-018", "eTenders", 72, "Medium", "Not pursuing", "9 Sep 2026"),
    ("T-2026-027", "eTenders / TED", 79, "High", "Shortlisted", "3 Oct 2026"),
]

# Id, score, band, status, value; agent, architect and contractor named or not; number of other parties.
_SIGNALS = [
    ("P-2026-101", 88, "High", "New", "€6.2m", True, True, True, 1),
    ("P-2026-114", 82, "High", "Review", "€18.5m", True, True, True, 1),
    ("P-2026-126", 64, "Medium", "New", "€9.8m", True, False, False, 0),
    ("P-2026-133", 55, "Medium", "New", "€4.1m", False, True, False, 0),
    ("P-2026-140", 47, "Low", "Not pursuing", "€22.0m", True, True, False, 0),
    ("P-2026-152", 73, "Medium", "Qualified", "€31.4m", True, True, False, 0),
]

# Fit and intent.
_LEADS = [(92, 88), (84, 91), (94, 37)]

# Counts of the stages of each funnel.
_FUNNELS = {"lead": (146, 72, 41, 26, 17, 15), "tender": (58, 19, 11, 6), "planning": (340, 42, 27, 6)}

# The parts of a cost, in EUR; quantities and costs of the sheet.
_COSTS = (18400, 6500, 2000)
_SHEET = ("€2 960,00", "€4 320,00", "€1 860,00", "€1 080,00", "€1 776,00", "€384,00")

# Total, per traveller and per day of each scenario.
_SCENARIOS = [("€14 880", "€3 720", "€2 126"), ("€16 240", "€4 060", "€2 320"), ("€12 960", "€3 240", "€1 851")]

# States of engagements and of travel plans.
_ENGAGEMENTS = ("Scheduled", "Awaiting dates", "Planning")
_PLANS = [("Engagement 1", "Awaiting approval"), ("Other 1", "Recheck required"), ("Engagement 2", "Booked"), ("Other 2", "Approved")]

# Level, correction, method and verdict of each measured position.
_REPORT = [(47, -4, "Measured", "Pass"), (46, -4, "Measured", "Pass"), (45, -5, "Measured", "Pass"), (44, -5, "Interpolated", "Review")]


def tenders(spark: SparkSession) -> DataFrame:
    rows = [
        (
            i, f"Tender {k}", "A buyer", "Acoustics", "A place", day, system, score, band, status, "A scope",
            ["A reason"], ["A requirement"], [("Deadline", day)], ["A risk"], _SOURCE, "An analysis",
        )
        for k, (i, system, score, band, status, day) in enumerate(_TENDERS)
    ]
    kinds = (
        "id string, title string, buyer string, category string, location string, deadline string, source_system string, "
        "fit_score int, fit_band string, status string, scope string, why_it_fits array<string>, "
        "mandatory_requirements array<string>, key_dates array<struct<label:string,date:string>>, risks array<string>, "
        "source struct<name:string,meta:string,note:string>, analysis string"
    )
    return collection(spark, rows, kinds).withColumn("deadline_date", F.try_to_date("deadline", "d MMM yyyy"))


def planning_signals(spark: SparkSession) -> DataFrame:
    rows = [
        (
            i, f"Project {k}", "A county", "A sector", "A stage", value, "A signal", score, band, status, "A trigger", "An applicant",
            "An agent" if agent else None, "An architect" if architect else None, "A contractor" if contractor else None,
            [f"Party {n}" for n in range(others)], [("Decision", "Q1 2027")], _SOURCE, "An analysis",
        )
        for k, (i, score, band, status, value, agent, architect, contractor, others) in enumerate(_SIGNALS)
    ]
    kinds = (
        "id string, project string, county string, sector string, stage string, value string, signal_type string, fit_score int, "
        "fit_band string, status string, acoustic_trigger string, applicant string, planning_agent string, architect string, "
        "main_contractor string, other_parties array<string>, key_dates array<struct<label:string,date:string>>, "
        "source struct<name:string,meta:string,note:string>, analysis string"
    )
    return collection(spark, rows, kinds).withColumn("value_eur", S.parse_eur(F.col("value")))


def priority_leads(spark: SparkSession) -> DataFrame:
    rows = [
        (
            f"0{k + 1}", f"Company {k}", "A city", "A sector", fit, intent, "A capacity", "A confidence", "not published", "310 ↑",
            ["A signal"], "A buyer", "An engineer", "An analysis",
        )
        for k, (fit, intent) in enumerate(_LEADS)
    ]
    return collection(
        spark, rows, "rank string, name string, city string, sector string, fit int, intent int, capacity string, confidence string, "
        "revenue string, employees string, signals array<string>, economic_buyer string, technical_buyer string, analysis string"
    )


def funnel(spark: SparkSession) -> DataFrame:
    """``ord`` counts within a funnel."""
    rows = [(name, i, f"Stage {i}", n) for name, counts in _FUNNELS.items() for i, n in enumerate(counts)]
    return spark.createDataFrame(rows, "funnel string, ord int, label string, value int")


def cost_breakdown(spark: SparkSession) -> DataFrame:
    rows = [(f"Part {k}", n) for k, n in enumerate(_COSTS)]
    return collection(spark, rows, "label string, amount int").select("ord", "label", F.col("amount").cast(S.MONEY).alias("amount_eur"))


def bom_sheet(spark: SparkSession) -> DataFrame:
    rows = [(f"Item {k}", str(k + 1), "pcs", cost) for k, cost in enumerate(_SHEET)]
    kinds = "item string, qty string, unit string, cost string"
    return collection(spark, rows, kinds).withColumns({"qty_n": F.col("qty").try_cast("int"), "cost_eur": S.parse_eur(F.col("cost"))})


def logistics_scenarios(spark: SparkSession) -> DataFrame:
    rows = [(f"Scenario {c} · Option", "A detail", *money, "8 nights", "A term") for c, money in zip("ABC", _SCENARIOS)]
    return collection(spark, rows, "name string, detail string, total string, per_traveller string, per_day string, duration string, cancellation string")


def engagements(spark: SparkSession) -> DataFrame:
    rows = [(f"Engagement {k}", "A client", "A city", "Nov 2026", status) for k, status in enumerate(_ENGAGEMENTS)]
    return collection(spark, rows, "name string, client string, city string, dates string, status string")


def travel_plans(spark: SparkSession) -> DataFrame:
    rows = [(name, "A note", "Yesterday", "€1 240", status) for name, status in _PLANS]
    return collection(spark, rows, "engagement string, note string, when_text string, cost string, status string")


def report_rows(spark: SparkSession) -> DataFrame:
    rows = [(f"Position {k}", str(level), str(ctr), method, verdict) for k, (level, ctr, method, verdict) in enumerate(_REPORT)]
    return collection(spark, rows, "pos string, dntw string, ctr string, method string, verdict string").withColumn("dntw_db", F.col("dntw").try_cast("double"))


def currency(spark: SparkSession) -> DataFrame:
    rows = [(code, rate, S.SYMBOLS[code]) for code, rate in S.RATES.items()]
    return collection(spark, rows, "code string, rate decimal(4,2), symbol string")


LOADERS = {
    f.__name__: f
    for f in (
        tenders, planning_signals, priority_leads, funnel, cost_breakdown, bom_sheet, logistics_scenarios, engagements, travel_plans,
        report_rows, currency,
    )
}


def load(spark: SparkSession, name: str) -> DataFrame:
    """A stored collection by name."""
    return LOADERS[name](spark)
