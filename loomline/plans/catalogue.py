"""Registered queries over the driver's tables, each beside its DuckDB equivalent.

``query`` registers both under one name.  Names from ``q_rank`` on are proposals of this library
(``operators.insights``): the prototype only mentions them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import scalars as S
from loomline.operators import insights as I
from loomline.operators import relational as R
from loomline.sources import collections, stores
from loomline.sources.stores import table
from loomline.streaming import transitions as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

STATUS = {"O": "Open", "F": "Filled", "P": "Pending"}
URL_KINDS = [("https://blog.", "blog"), ("https://www.", "site"), ("https://m.", "mobile"), ("http://", "plain")]
TERMS = ["license", "copyright", "password"]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a readable status and their totals in three currencies."""
    total = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", S.lookup(F.col("o_orderstatus"), STATUS, "Not identified").alias("status"),
        *[S.format_money(total, c).alias(f"total_{c.lower()}") for c in S.RATES],
    )


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def q_project(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer")
def q_struct_field(spark, d):
    nested = table(spark, d, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("source"))
    return nested.select("c_custkey", "source.name", "source.segment")


@query("SELECT p_partkey, 'Brand' AS label, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'Type', p_type FROM part")
def q_unpivot(spark, d):
    return R.unpivot_fields(table(spark, d, "part"), ["p_partkey"], {"p_brand": "Brand", "p_type": "Type"})


@query("SELECT o_orderkey, coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), 'Not identified') AS priority FROM orders")
def q_null_fallback(spark, d):
    found = F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED"))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(found, F.lit("Not identified")).alias("priority"))


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P'")
def q_filter_count(spark, d):
    return R.count_where(table(spark, d, "orders"), F.col("o_orderstatus") == "P")


@query("SELECT count(*) AS n FROM nation")
def q_count_all(spark, d):
    return R.count_all(table(spark, d, "nation"))


@query("SELECT count(*) > 0 AS any_rows FROM nation")
def q_nonempty(spark, d):
    return R.non_empty(table(spark, d, "nation"))


@query("SELECT o_orderkey, nullif(o_orderstatus, 'P') AS badge FROM orders WHERE nullif(o_orderstatus, 'P') IS NOT NULL")
def q_present_only(spark, d):
    badged = table(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("badge"))
    return R.present_only(badged, "badge")


@query("""SELECT CASE l_returnflag WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Accepted' ELSE 'None' END AS label,
       l_orderkey, l_quantity FROM lineitem""")
def q_case_label(spark, d):
    flag = F.col("l_returnflag")
    label = F.when(flag == "R", "Returned").when(flag == "A", "Accepted").otherwise("None")
    return table(spark, d, "lineitem").select(label.alias("label"), "l_orderkey", "l_quantity")


@query("""SELECT page_id, CASE WHEN starts_with(url, 'https://blog.') THEN 'blog' WHEN starts_with(url, 'https://www.') THEN 'site'
       WHEN starts_with(url, 'https://m.') THEN 'mobile' WHEN starts_with(url, 'http://') THEN 'plain' END AS kind FROM pages""")
def q_prefix_classify(spark, d):
    return table(spark, d, "pages").select("page_id", S.classify_prefix(F.col("url"), URL_KINDS).alias("kind"))


@query("""SELECT o_orderkey, v.label AS status FROM orders
       LEFT JOIN (VALUES ('O', 'Open'), ('F', 'Filled'), ('P', 'Pending')) v(code, label) ON v.code = o_orderstatus""")
def q_enum_lookup(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.lookup(F.col("o_orderstatus"), STATUS).alias("status"))


@query("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 1 OFFSET 3")
def q_nth_row(spark, d):
    return R.nth_row(table(spark, d, "region").select("r_regionkey", "r_name"), 3, "r_regionkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN 'R' ELSE o_orderstatus END AS o_orderstatus
       FROM orders""")
def q_conditional_update(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return R.update_first(orders, "o_orderkey", "o_orderstatus", "R")


@query("SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS idx FROM nation")
def q_row_index(spark, d):
    return R.row_index(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders")
def q_row_index_parts(spark, d):
    return R.row_index(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT n_nationkey, lead(n_name) OVER (ORDER BY n_nationkey) IS NULL AS is_last FROM nation")
def q_is_last(spark, d):
    return R.mark_last(table(spark, d, "nation").select("n_nationkey"), "n_nationkey")


@query("SELECT n_nationkey, (n_nationkey + 1) % 25 AS next FROM nation")
def q_cyclic_next(spark, d):
    return table(spark, d, "nation").select("n_nationkey", R.cyclic_next(F.col("n_nationkey"), 25).alias("next"))


@query("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 3")
def q_first_n(spark, d):
    return R.first_n(table(spark, d, "region").select("r_regionkey", "r_name"), 3, "r_regionkey")


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS first_word FROM part")
def q_array_first(spark, d):
    return table(spark, d, "part").select("p_partkey", F.get(F.split("p_name", " "), F.lit(0)).alias("first_word"))


@query("""SELECT p_partkey, i - 1 AS pos, words[i] AS item FROM (SELECT p_partkey, string_split(p_name, ' ') AS words,
       unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)""")
def q_explode(spark, d):
    return R.explode_list(table(spark, d, "part"), ["p_partkey"], F.split("p_name", " "))


@query("SELECT p_partkey, 'brand' AS label, p_brand AS date FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part")
def q_explode_struct(spark, d):
    items = F.array(*[F.struct(F.lit(k).alias("label"), F.col(f"p_{k}").alias("date")) for k in ("brand", "type")])
    return R.explode_structs(table(spark, d, "part"), ["p_partkey"], items)


@query("SELECT p_partkey, array_to_string(string_split(p_name, ' ')[2:], ' ') AS rest FROM part")
def q_array_remove_at(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(S.remove_at(F.split("p_name", " "), 0), " ").alias("rest"))


@query("SELECT p_partkey, p_name || ' extra' AS items FROM part")
def q_append(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_append(F.split("p_name", " "), "extra"), " ").alias("items"))


@query("""SELECT p_partkey, CASE WHEN list_contains(string_split(p_name, ' '), string_split(p_name, ' ')[1]) THEN p_name END AS same,
       p_name || ' extra' AS more FROM part""")
def q_append_distinct(spark, d):
    words = F.split("p_name", " ")
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(S.append_distinct(words, F.get(words, F.lit(0))), " ").alias("same"), F.array_join(S.append_distinct(words, "extra"), " ").alias("more")
    )


@query("SELECT p_partkey, list_contains(string_split(p_name, ' '), 'steel') AS has FROM part")
def q_array_contains(spark, d):
    return table(spark, d, "part").select("p_partkey", S.contains(F.split("p_name", " "), "steel").alias("has"))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'EXTRA' WHERE true")
def q_conditional_append(spark, d):
    regions = table(spark, d, "region").select("r_regionkey", "r_name")
    return R.append_if(regions, spark.createDataFrame([(99, "EXTRA")], regions.schema), True)


def _money_sql(currency: str, rate: str) -> str:
    cents = f"CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * CAST({rate} AS DECIMAL(4,2)), 2) * 100 AS BIGINT)"
    text = f"format('{{:,}}', {cents} // 100) || '.' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0')"
    text = f"translate({text}, ',.', ' ,')" if currency == "EUR" else text
    return f"SELECT o_orderkey, '{S.SYMBOLS[currency]}' || {text} AS amount FROM orders"


def _money(currency: str):
    def run(spark, d):
        return table(spark, d, "orders").select("o_orderkey", S.format_money(F.col("o_totalprice"), currency).alias("amount"))

    name = run.__name__ = f"q_currency_{currency.lower()}"
    QUERIES[name], ORACLE_SQL[name] = run, _money_sql(currency, str(S.RATES[currency]))


for _c in S.RATES:
    _money(_c)


@query("SELECT p_partkey, p_name AS name FROM part")
def q_space_normalize(spark, d):
    odd = F.translate("p_name", " ", "\u202f")
    return table(spark, d, "part").select("p_partkey", S.plain_spaces(odd).alias("name"))


@query("SELECT o_orderkey, regexp_replace(o_orderpriority, '-', ': ') AS priority FROM orders")
def q_replace_first(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.replace_first(F.col("o_orderpriority"), "-", ": ").alias("priority"))


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS level FROM orders")
def q_split_first(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.split_first(F.col("o_orderpriority"), "-").alias("level"))


@query("SELECT p_partkey, upper(p_name) AS name FROM part")
def q_upper(spark, d):
    return table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("name"))


@query("SELECT p_partkey, lower(p_type) AS kind FROM part")
def q_lower(spark, d):
    return table(spark, d, "part").select("p_partkey", F.lower("p_type").alias("kind"))


@query("SELECT c_custkey, c_name || ' · ' || c_mktsegment AS label FROM customer")
def q_label_concat(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.joined(F.col("c_name"), F.col("c_mktsegment")).alias("label"))


_TRIMMED = "trim(text, E' \\t\\n\\r\\u00a0')"


def _with_blanks(spark, d):
    """All turns, and a blank one more for every third."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return rows.unionByName(rows.filter("turn % 3 = 0").withColumn("text", F.lit(" \t ")))


@query(f"SELECT conv_id, turn, {_TRIMMED} AS text FROM conversations WHERE {_TRIMMED} <> ''")
def q_trim_nonblank(spark, d):
    padded = _with_blanks(spark, d).withColumn("text", F.concat(F.lit(" \t "), "text", F.lit(" ")))
    return padded.filter(~S.is_blank(F.col("text"))).withColumn("text", S.trim_all(F.col("text")))


@query(f"""SELECT conv_id, turn, coalesce(nullif({_TRIMMED}, ''), 'no text') AS text FROM conversations
       UNION ALL SELECT conv_id, turn, 'no text' FROM conversations WHERE turn % 3 = 0""")
def q_default_if_blank(spark, d):
    return _with_blanks(spark, d).select("conv_id", "turn", S.default_if_blank(F.col("text"), "no text").alias("text"))


# ---------------------------------------------------------------- proposals

@query("""SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank
       FROM customer""")
def q_rank(spark, d):
    return I.ranked(table(spark, d, "customer"), "c_acctbal", "c_custkey", ["c_nationkey"]).select("c_custkey", "c_nationkey", "rank")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_size * 2 >= 79 THEN 'High' WHEN p_size * 2 >= 68 THEN 'Medium' ELSE 'Low' END
       ELSE CASE WHEN p_size * 2 >= 82 THEN 'High' WHEN p_size * 2 >= 55 THEN 'Medium' ELSE 'Low' END END AS band FROM part""")
def q_fit_band(spark, d):
    source = F.when(F.col("p_partkey") % 2 == 0, "tender").otherwise("planning")
    return table(spark, d, "part").select("p_partkey", I.fit_band(source, F.col("p_size") * 2).alias("band"))


@query("""WITH c AS (SELECT count(*) AS a, count(*) FILTER (WHERE o_orderstatus <> 'F') AS b,
       count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_totalprice > 100000) AS c FROM orders)
       SELECT 0 AS ord, 'All' AS label, a AS value, CAST(NULL AS DOUBLE) AS rate FROM c
       UNION ALL SELECT 1, 'Not filled', b, CASE WHEN a > 0 THEN CAST(b AS DOUBLE) / a END FROM c
       UNION ALL SELECT 2, 'Large', c, CASE WHEN b > 0 THEN CAST(c AS DOUBLE) / b END FROM c""")
def q_funnel(spark, d):
    stages = [("All", F.lit(True)), ("Not filled", F.col("o_orderstatus") != "F"), ("Large", F.col("o_totalprice") > 100000)]
    return I.funnel(table(spark, d, "orders"), stages)


@query("SELECT o_orderkey FROM orders WHERE date_diff('day', DATE '1996-01-01', CAST(o_orderdate AS DATE)) BETWEEN 0 AND 30")
def q_closing_within(spark, d):
    return I.closing_within(table(spark, d, "orders"), F.col("o_orderdate"), F.lit("1996-01-01").cast("date")).select("o_orderkey")


@query("""SELECT doc_id, regexp_matches(lower(text), '(^|[^0-9a-z_])(license|copyright|password)([^0-9a-z_]|$)') AS mentions FROM documents""")
def q_term_mentions(spark, d):
    return table(spark, d, "documents").select("doc_id", I.mentions(F.col("text"), TERMS).alias("mentions"))


@query("""SELECT l_orderkey, l_quantity, CASE WHEN l_returnflag = 'N' AND l_quantity >= 45 THEN 'Pass' ELSE 'Review' END AS verdict FROM lineitem""")
def q_verdict(spark, d):
    method = F.when(F.col("l_returnflag") == "N", "Measured").otherwise("Interpolated")
    return table(spark, d, "lineitem").select("l_orderkey", "l_quantity", I.verdict(method, F.col("l_quantity")).alias("verdict"))


@query("""WITH v AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS x FROM orders),
       w AS (SELECT *, last_value(x IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
       first_value(x IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM v)
       SELECT o_custkey, o_orderkey, coalesce(x, (b + a) / 2, b, a) AS filled FROM w""")
def q_gap_fill(spark, d):
    gappy = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("x"))
    return I.fill_gaps(gappy, "x", ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "filled")


@query("""SELECT o_orderstatus AS label, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders
       GROUP BY ROLLUP (o_orderstatus)""")
def q_cost_rollup(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("label"), F.col("o_totalprice").cast(S.MONEY).alias("x"))
    return I.cost_rollup(rows, "label", "x").select("label", F.col("amount").cast("double").alias("amount"))


@query("""SELECT o_orderkey, CAST((CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) + 2) // 4 AS DOUBLE) / 100 AS per_traveller FROM orders""")
def q_per_unit(spark, d):
    total = F.col("o_totalprice").cast(S.MONEY)
    return table(spark, d, "orders").select("o_orderkey", I.per_unit(total, F.lit(4)).cast("double").alias("per_traveller"))


@query("""WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
       SELECT coalesce(c.k, s.k) AS k, c.k IS NOT NULL AS in_left, s.k IS NOT NULL AS in_right FROM c FULL OUTER JOIN s ON c.k = s.k""")
def q_linked(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    return I.linked(c, s, "k")


# their names while other queries of these names left rows out
for _name in ("q_per_unit", "q_trim_nonblank", "q_default_if_blank", "q_linked"):
    QUERIES[f"{_name}_all"], ORACLE_SQL[f"{_name}_all"] = QUERIES[_name], ORACLE_SQL[_name]


# ---------------------------------------------------------------- states and settings

#: What each type of event does to each machine.
STEPS = {
    "logistics": {"view": "ask", "click": "answer", "purchase": "approve", "signup": "choose"},
    "consult": {"view": "choose", "click": "send"},
    "build": {"click": "send"},
    "marketing": {"click": "send", "purchase": "approve"},
    "scan": {"click": "run", "view": "finish"},
    "research": {"click": "run", "view": "finish"},
}


def _replay_sql(name: str) -> str:
    moves, start = T.MACHINES[name]
    event = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STEPS[name].items()) + " ELSE 'other' END"
    to = " ".join(f"WHEN s = '{state}' AND e = '{event}' THEN '{to}'" for (state, event), to in moves.items())
    return f"""SELECT user_id, list_reduce(list({event} ORDER BY ts, event_id), lambda s, e: CASE {to} ELSE s END, '{start}') AS state
        FROM events GROUP BY user_id"""


def _replay(name: str):
    def run(spark, d):
        moves, start = T.MACHINES[name]
        event = S.lookup(F.col("event_type"), STEPS[name], "other").alias("event")
        events = table(spark, d, "events").select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("at"), event)
        return T.replay(events, moves, start).withColumnRenamed("key", "user_id")

    run.__name__ = f"q_replay_{name}"
    QUERIES[run.__name__], ORACLE_SQL[run.__name__] = run, _replay_sql(name)


for _m in T.MACHINES:
    _replay(_m)


@query("""SELECT k.key AS key, coalesce(max(CAST(n_regionkey AS VARCHAR)), 'none') AS value
       FROM (VALUES ('FRANCE'), ('NATION_7'), ('ATLANTIS')) k(key) LEFT JOIN nation ON n_name = k.key GROUP BY k.key""")
def q_setting_default(spark, d):
    state = table(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    one = lambda key: stores.setting(state, key, "none").select(F.lit(key).alias("key"), "value")
    return one("FRANCE").unionByName(one("NATION_7")).unionByName(one("ATLANTIS"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false ELSE true END AS open FROM orders""")
def q_open_flag(spark, d):
    stored = S.lookup(F.col("o_orderstatus"), {"O": "open", "F": "closed"})
    return table(spark, d, "orders").select("o_orderkey", S.open_flag(stored, True).alias("open"))


@query("SELECT p_partkey, NOT (p_size > 25) AS flag FROM part")
def q_toggle(spark, d):
    return table(spark, d, "part").select("p_partkey", S.toggled(F.col("p_size") > 25).alias("flag"))


# ---------------------------------------------------------------- stored collections

#: Queries of the literal collections: they read no table, so they are tested but not registered.
STORED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def stored(sql: str):
    def add(f):
        STORED[f.__name__] = f, sql
        return f

    return add


@stored("""SELECT * FROM (VALUES
       ('T-2026-014', DATE '2026-09-18', 'High'), ('T-2026-021', DATE '2026-10-05', 'High'), ('T-2026-009', DATE '2026-08-30', 'Medium'),
       ('T-2026-033', DATE '2026-09-12', 'Medium'), ('T-2026-041', DATE '2026-09-25', 'Low'), ('T-2026-018', DATE '2026-09-09', 'Medium'),
       ('T-2026-027', DATE '2026-10-03', 'High')) t(id, deadline_date, band)""")
def q_stored_tenders(spark, d):
    return collections.load(spark, "tenders").select("id", "deadline_date", I.fit_band(F.lit("tender"), F.col("fit_score")).alias("band"))


@stored("""SELECT id, architect, CAST(value_eur AS DOUBLE) AS value_eur, CAST(parties AS INTEGER) AS parties FROM (VALUES
       ('P-2026-101', 'An architect', 6200000, 1), ('P-2026-114', 'An architect', 18500000, 1), ('P-2026-126', 'Not identified', 9800000, 0),
       ('P-2026-133', 'An architect', 4100000, 0), ('P-2026-140', 'An architect', 22000000, 0), ('P-2026-152', 'An architect', 31400000, 0))
       t(id, architect, value_eur, parties)""")
def q_stored_signals(spark, d):
    return collections.load(spark, "planning_signals").select(
        "id", F.coalesce("architect", F.lit("Not identified")).alias("architect"), F.col("value_eur").cast("double").alias("value_eur"),
        F.size("other_parties").alias("parties"),
    )


@stored("""SELECT CAST(1 AS BIGINT) AS n, CAST(26900 AS DOUBLE) AS total, '€26 900,00' AS eur, '£23,134.00' AS gbp, '$29,321.00' AS usd""")
def q_stored_totals(spark, d):
    recheck = R.count_where(collections.load(spark, "travel_plans"), F.col("status") == "Recheck required")
    total = collections.load(spark, "cost_breakdown").agg(F.sum("amount_eur").alias("total"))
    money = [S.format_money(F.col("total"), c).alias(c.lower()) for c in S.RATES]
    return recheck.join(F.broadcast(total)).select("n", *money, F.col("total").cast("double").alias("total"))
