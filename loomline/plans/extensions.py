"""Registered queries beyond the catalogue: round trips of the prototype's sinks, its scans by suggestion and its timers,
and extensions that it has nothing of (joins in time, percentiles, sessions, dates of a precision, division).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import dates
from loomline.functions import scalars as S
from loomline.operators import insights as I
from loomline.operators import paths, selection, timejoins
from loomline.plans.catalogue import ORACLE_SQL, QUERIES, query
from loomline.sources import stores
from loomline.sources.scratch import Scratch
from loomline.sources.stores import table
from loomline.streaming import sessions, transitions


@query("""WITH s AS (SELECT o_custkey AS c, l_shipdate AS at, l_orderkey AS k, l_linenumber AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
       m AS (SELECT o_orderkey, s.at, s.k, s.n, row_number() OVER (PARTITION BY o_orderkey ORDER BY s.at DESC, s.k DESC, s.n DESC) AS place
       FROM orders JOIN s ON s.c = o_custkey AND s.at <= o_orderdate)
       SELECT o.o_orderkey, m.at AS shipped, m.k AS shipped_order, m.n AS shipped_line FROM orders o LEFT JOIN m ON m.o_orderkey = o.o_orderkey AND place = 1""")
def q_asof_shipment(spark, d):
    """Each order with the latest shipment to its customer at or before its date."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    sent = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    values = {"l_shipdate": "shipped", "l_orderkey": "shipped_order", "l_linenumber": "shipped_line"}
    found = timejoins.asof(orders, sent, [("o_custkey", "o_custkey")], ("o_orderdate", "l_shipdate"), values, ["l_orderkey", "l_linenumber"])
    return found.select("o_orderkey", *values.values())


def _micros(at):
    """Whole microseconds of a time without a zone."""
    return F.unix_micros(F.to_timestamp_ltz(at.cast("string")))


_SPAN = "SELECT event_id, user_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 60000000) AS BIGINT) AS e FROM events"


@query(f"""WITH x AS ({_SPAN}) SELECT a.event_id AS event_id, b.event_id AS other_id, greatest(a.s, b.s) AS since, least(a.e, b.e) AS until
       FROM x a JOIN x b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s <= b.e AND b.s <= a.e""")
def q_overlapping_events(spark, d):
    """Pairs of events of a user that overlap, an event lasting as many minutes as its value says."""
    start = _micros(F.col("ts"))
    events = table(spark, d, "events").select("event_id", "user_id", start.alias("s"), (start + F.round(F.col("value") * 60_000_000).cast("long")).alias("e"))
    span = (F.col("s"), F.col("e"))
    pairs = timejoins.overlaps(events, events, [("user_id", "user_id")], span, span).filter("left.event_id < right.event_id")
    return pairs.select(
        F.col("left.event_id").alias("event_id"), F.col("right.event_id").alias("other_id"),
        F.greatest("left.s", "right.s").alias("since"), F.least("left.e", "right.e").alias("until"),
    )


SHARES = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]


@query(f"""SELECT l_returnflag, unnest(CAST({SHARES} AS DOUBLE[])) AS share, unnest(quantile_disc(l_extendedprice, {SHARES})) AS price FROM lineitem GROUP BY l_returnflag""")
def q_price_percentiles(spark, d):
    found = selection.percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", SHARES)
    return found.select("l_returnflag", "share", F.col("l_extendedprice").alias("price"))


@query(f"""SELECT source, lang, unnest(CAST({SHARES} AS DOUBLE[])) AS share, unnest(quantile_disc(n_chars, {SHARES})) AS chars FROM documents GROUP BY source, lang""")
def q_length_percentiles(spark, d):
    found = selection.percentiles(table(spark, d, "documents"), ["source", "lang"], "n_chars", SHARES)
    return found.select("source", "lang", "share", F.col("n_chars").alias("chars"))


@query("""SELECT o_orderkey AS "Order", '€' || replace(replace(replace(format('{:,.2f}', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)), ',', ' '), '.', ','), 'x', '') AS "Total",
       o_orderpriority AS "Priority" FROM orders""")
def q_csv_round_trip(spark, d):
    """All orders exported as CSV under their headings, with the amounts as text, and read back."""
    total = F.translate(F.format_number(F.col("o_totalprice").cast(S.MONEY), 2), ",.", " ,")
    where = Scratch(spark, "csv").path("orders")
    stores.export_csv(table(spark, d, "orders"), where, {"Order": "o_orderkey", "Total": F.concat(F.lit("€"), total), "Priority": "o_orderpriority"})
    return spark.read.option("header", True).schema("`Order` long, Total string, Priority string").csv(where)


@query("""SELECT n_name AS key, CASE n_name WHEN 'NATION_7' THEN 'changed' ELSE CAST(n_regionkey AS VARCHAR) END AS value FROM nation
       UNION ALL SELECT 'FRANCE', 'new' WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_name = 'FRANCE')""")
def q_setting_round_trip(spark, d):
    """The nations as a stored state: one key replaced, one added, written and read after each."""
    where = Scratch(spark, "state").path("settings")
    stores.write_state(table(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value")), where)
    for key, value in (("NATION_7", "changed"), ("FRANCE", "new")):
        stores.write_state(stores.with_setting(stores.read_state(spark, where), key, value), where)
    return stores.read_state(spark, where)


# ---------------------------------------------------------------- sessions and timers

HOURS = 3_600_000_000


@query(f"""WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events),
       f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= {6 * HOURS} THEN 0 ELSE 1 END AS new FROM e),
       s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM f)
       SELECT user_id, min(t) AS session_start, max(t) AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def q_sessions(spark, d):
    events = table(spark, d, "events").select("user_id", _micros(F.col("ts")).alias("t"))
    return sessions.sessions(events, "user_id", "t", 6 * HOURS)


def _timed(name: str, event: str, timers: dict[str, tuple[int, str]], moves: dict[tuple[str, str], str]) -> None:
    """A scan that an event starts, that runs for its timer, and that is started anew only once it has ended."""
    ((busy, (took, done)),) = timers.items()
    starts = ", ".join(f"'{state}'" for state, e in moves if e == "run")
    fired = f"(a.s = '{busy}' AND a.e + {took} <= x.e)"
    now = f"(CASE WHEN {fired} THEN '{done}' ELSE a.s END)"
    sql = f"""SELECT user_id, r.s AS state, r.e AS entered FROM (SELECT user_id, list_reduce(
        list(struct_pack(s := CASE WHEN event_type = '{event}' THEN 'run' ELSE 'other' END, e := epoch_us(ts)) ORDER BY ts, event_id),
        lambda a, x: CASE WHEN x.s = 'run' AND {now} IN ({starts}) THEN struct_pack(s := '{busy}', e := x.e)
        ELSE struct_pack(s := {now}, e := CASE WHEN {fired} THEN a.e + {took} ELSE a.e END) END,
        struct_pack(s := 'empty', e := CAST(NULL AS BIGINT))) AS r FROM events GROUP BY user_id)"""

    def run(spark, d):
        kind = F.when(F.col("event_type") == event, "run").otherwise("other")
        events = table(spark, d, "events").select(F.col("user_id").alias("key"), _micros(F.col("ts")).alias("at"), kind.alias("event"))
        return transitions.replay_timed(events, moves, "empty", timers).withColumnRenamed("key", "user_id")

    run.__name__ = name
    QUERIES[name], ORACLE_SQL[name] = run, sql


#: The moves of the machines without the event that tells the end: here a timer does.
_timed("q_timed_scan", "click", transitions.SCAN_TIMERS, {k: v for k, v in transitions.SCAN.items() if k[1] == "run"})
_timed("q_timed_long_research", "view", {"researching": (9 * HOURS, "results")}, {k: v for k, v in transitions.RESEARCH.items() if k[1] == "run"})


# ---------------------------------------------------------------- suggestions, dates, division

_TEXT = "lower(text)"
_HAS = "regexp_matches(" + _TEXT + ", '(^|[^0-9a-z_])({})([^0-9a-z_]|$)')"


@query("""WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS deadline, o_totalprice AS p, nullif(o_orderpriority, '4-NOT SPECIFIED') AS a FROM orders)
       SELECT 'closing in the next 30 days' AS suggestion, id FROM o WHERE date_diff('day', DATE '1997-06-01', deadline) BETWEEN 0 AND 30
       UNION ALL SELECT 'strong fit', id FROM o WHERE CAST(floor(p / 5000) AS INT) >= 79
       UNION ALL SELECT 'architect has been identified', id FROM o WHERE a IS NOT NULL
       UNION ALL SELECT 'high value', id FROM o WHERE p * 20 >= 5000000
       UNION ALL SELECT 'planning, environmental noise or building acoustics', doc_id FROM documents WHERE """
       + _HAS.format("planning|environmental noise|building acoustics"))
def q_suggestions(spark, d):
    """What each suggestion finds: orders stand for opportunities, documents for their texts."""
    band = I.fit_band(F.lit("tender"), F.floor(F.col("o_totalprice") / 5000).cast("int"))
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("deadline"), band.alias("band"),
        F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("architect"), (F.col("o_totalprice") * 20).alias("value_eur"),
    )
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    as_of = F.lit("1997-06-01").cast("date")
    found = lambda rows, name: I.suggested(rows, name, as_of).select(F.lit(name).alias("suggestion"), "id")
    out = found(texts, "planning, environmental noise or building acoustics")
    for name in ("closing in the next 30 days", "strong fit", "architect has been identified", "high value"):
        out = out.unionByName(found(orders, name))
    return out


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 5 AS form, o_orderpriority AS p FROM orders),
       s AS (SELECT o_orderkey, CASE form WHEN 0 THEN strftime(d, '%-d %b %Y') WHEN 1 THEN strftime(d, '%b %Y') WHEN 2 THEN 'Q' || quarter(d) || ' ' || year(d)
       WHEN 3 THEN CAST(year(d) AS VARCHAR) ELSE p END AS text,
       CASE form WHEN 0 THEN d WHEN 1 THEN date_trunc('month', d) WHEN 2 THEN date_trunc('quarter', d) WHEN 3 THEN date_trunc('year', d) END AS first_day,
       CASE form WHEN 0 THEN d WHEN 1 THEN date_trunc('month', d) + INTERVAL 1 MONTH - INTERVAL 1 DAY WHEN 2 THEN date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY
       WHEN 3 THEN date_trunc('year', d) + INTERVAL 1 YEAR - INTERVAL 1 DAY END AS last_day FROM o)
       SELECT o_orderkey, text, CAST(first_day AS DATE) AS first_day, CAST(last_day AS DATE) AS last_day,
       CASE WHEN last_day < DATE '1998-02-10' THEN true WHEN first_day >= DATE '1998-02-10' THEN false END AS early FROM s""")
def q_date_precision(spark, d):
    """Order dates written to the day, the month, the quarter or the year, or not as dates, and read back; whether they lie before a day."""
    day, form = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 5
    text = (
        F.when(form == 0, F.date_format(day, "d MMM yyyy")).when(form == 1, F.date_format(day, "MMM yyyy"))
        .when(form == 2, F.concat(F.lit("Q"), F.quarter(day), F.lit(" "), F.year(day))).when(form == 3, F.year(day).cast("string")).otherwise(F.col("o_orderpriority"))
    )
    spans = table(spark, d, "orders").select("o_orderkey", text.alias("text")).withColumn("span", dates.span_of(F.col("text")))
    return spans.select(
        "o_orderkey", "text", F.col("span.first").alias("first_day"), F.col("span.last").alias("last_day"),
        dates.before(F.col("span"), dates.span_of(F.lit("10 Feb 1998"))).alias("early"),
    )


@query("""WITH w AS (SELECT DISTINCT p_type FROM part WHERE p_brand = 'Brand#7'),
       h AS (SELECT DISTINCT l_suppkey, p_type FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type IN (FROM w))
       SELECT s.l_suppkey FROM (SELECT DISTINCT l_suppkey FROM lineitem) s LEFT JOIN h ON h.l_suppkey = s.l_suppkey
       GROUP BY s.l_suppkey HAVING count(h.p_type) = (SELECT count(*) FROM w)""")
def q_covering_suppliers(spark, d):
    """Suppliers that have sent every type of part that a brand has."""
    part = table(spark, d, "part")
    sent = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return I.covering(sent, "l_suppkey", "p_type", part.filter("p_brand = 'Brand#7'").select("p_type"))


# ---------------------------------------------------------------- JSON

_NOTE = """'{"key": ' || o_orderkey || ', "state": ' || CASE o_orderstatus WHEN 'O' THEN '"open"' WHEN 'F' THEN '1.5' ELSE 'null' END
       || ', "who": {"id": ' || o_custkey || CASE WHEN o_custkey % 2 = 0 THEN ', "even": true' ELSE '' END || '}, "parts": ["'
       || replace(o_orderpriority, '-', '", "') || '", ' || o_orderkey % 3 || CASE WHEN o_orderkey % 4 = 0 THEN ', {"id": [0.5, []]}' ELSE '' END
       || CASE WHEN o_orderkey % 7 = 0 THEN ']' ELSE ']}' END"""


@query(f"""WITH RECURSIVE x AS (SELECT 'events' AS origin, props AS text FROM events UNION ALL SELECT 'orders', {_NOTE} FROM orders),
       j AS (SELECT origin, CAST(text AS JSON) AS v FROM x WHERE json_valid(text)),
       t AS (SELECT origin, regexp_replace(t.fullkey, '\\[[0-9]+\\]', '[*]', 'g') AS path, CASE t.type WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string'
       WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'DOUBLE' THEN 'number' ELSE 'integer' END AS kind FROM j, json_tree(j.v) t),
       c AS (SELECT origin, path, kind, count(*) AS n, list_position(['null', 'boolean', 'integer', 'number', 'string', 'array', 'object'], kind) AS spot FROM t GROUP BY ALL),
       p AS (SELECT origin, path, CAST(sum(n) AS BIGINT) AS n_values, string_agg(kind || ':' || n, ',' ORDER BY spot) AS kinds,
       list_sort(list(kind) FILTER (kind <> 'null')) AS told, regexp_replace(path, '(\\.[A-Za-z0-9_]+|\\[\\*\\])$', '') AS above FROM c GROUP BY ALL)
       SELECT p.origin, p.path, CASE WHEN told IS NULL OR len(told) = 0 THEN 'null' WHEN len(told) = 1 THEN told[1] WHEN told = ['integer', 'number'] THEN 'number' ELSE 'mixed' END AS kind,
       kinds, n_values, CASE WHEN p.path = '$' THEN (SELECT count(*) FROM x WHERE x.origin = p.origin) ELSE c.n END AS n_parents
       FROM p LEFT JOIN c ON p.path <> '$' AND c.origin = p.origin AND c.path = p.above AND c.kind = CASE WHEN ends_with(p.path, '[*]') THEN 'array' ELSE 'object' END""")
def q_json_paths(spark, d):
    """Kinds at every path of the events' properties and of notes made of the orders, some of which are no JSON."""
    events = table(spark, d, "events").select(F.lit("events").alias("origin"), F.col("props").alias("text"))
    return paths.json_paths(events.unionByName(table(spark, d, "orders").select(F.lit("orders").alias("origin"), F.expr(_NOTE).alias("text"))), "text", ["origin"])
