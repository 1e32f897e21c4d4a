"""Every operator and the pipeline on texts of a megabyte that repeat the beginnings of what is looked for."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from loomline.llm import bpe_heap, bpe_matrix, chat_trees, decontaminate, filter_audit, jaccard_join, kk_sharding, lexical_search, ngram_trie, queries, secret_ledger, source_mixing, toxicity
from loomline.llm.common import Scratch

P = pytest.importorskip("public_tokenizers")
MB = 1_000_000


def long_texts():
    rng = random.Random(9)
    letters = lambda n, abc: "".join(rng.choice(abc) for _ in range(n))
    repeats = ["-----BEGIN ", "-----BEGIN RSA ", "eyJ", "eyJ-", "eyJaaaaaaaa.", "eyJaaaaaaaa.eyJ", "token", "token ", "api_key: '", "AKIA", "AKIA ", "0123456789abcdef0123 ", "<s>[INST]", "w "]
    out = [(r * (MB // len(r)))[:MB] for r in repeats]
    out += ["-----BEGIN " + "AB " * (MB // 3), "password" + " " * MB, "password=" + " " * MB + "hunter2", letters(MB, "abcdefghij"), "a" * MB, "é" * (MB // 2), " " * MB, "0a" * (MB // 2)]
    out += [" ".join(f"w{rng.randrange(50_000)}" for _ in range(MB // 7))]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(long_texts())] + [(900, None, None, None, 0), (901, "short text", "en", "s", 10)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8)


def test_secrets_in_long_texts(spark, docs):
    """No stack overflow, and time in proportion to length."""
    began = time.time()
    ledger = secret_ledger.Ledger(spark, Scratch(spark, "long").path("ledger"))
    ledger.update(docs, "doc_id")
    rank = {r.kind: i for i, r in enumerate(ledger.rules)}
    found = {r["path"]: sorted((f["start"], rank[f["kind"]], f["kind"], f["end"]) for f in r["found"] or []) for r in ledger.paths().collect()}
    for i, t in enumerate(long_texts()):
        base = [s for s in found[i] if s[2] in ("assign", "access", "hex")]
        n = [sum(s[2] == k for s in base) for k in ("assign", "access", "hex")]
        assert (*n, brute.sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in base))) == brute.secrets(t), t[:20]
    assert secret_ledger.redact(docs).count() == docs.count()
    assert time.time() - began < 240


def test_tokens_of_long_texts(docs):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    known = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=bpe_matrix.Encoder(path, P.PATTERN).ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe_matrix.digests(docs.select("doc_id", "text"), path, P.PATTERN).collect()}
    for i, t in enumerate(long_texts()):
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        try:
            ids = known.encode_ordinary(t)
        except BaseException as e:  # the library gives up on some of them
            assert "Panic" in type(e).__name__
            continue
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_all_operators_on_long_texts(spark, docs, tmp_path):
    docs = docs.filter("doc_id in (0, 2, 13, 14, 17, 22, 900, 901)")  # one of each kind, a megabyte each
    n = docs.count()
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "w " * 30), (2, " ".join(f"w{i}" for i in range(40)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    toxic = [(i, 1, int(i % 2 == 0)) for i in (2, 13, 901)]
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", "<s>[INST] " * 100_000), (2, 0, "user", None)], "conv_id long, turn int, role string, text string")
    rows.write.parquet(str(tmp_path / "conversations.parquet"))
    whole = ("op1_ngram_trie", "op2_kk_sharding", "op4_secret_history", "op5_bpe_heap", "op7_toxicity", "op8_jaccard_join", "op9_decontaminate", "op12_source_mixing")
    for name in whole:
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == n * (2 if name == "op4_secret_history" else 1), name
    chats = {r["conv_id"]: r for r in chat_trees.op10_chat_trees(spark, str(tmp_path)).collect()}
    assert chats[1]["loss_chars"] == 1_000_000
    assert filter_audit.op11_filter_audit(spark, str(tmp_path)).agg(F.max("kept")).first()[0] <= n
    assert lexical_search.op13_lexical_search(spark, str(tmp_path)).filter("item_id = 1 and rank = 1").count() == 1
    kept = corpus_pipeline.run(spark, str(tmp_path))
    assert kept.count() <= n and "n_tokens" in kept.columns


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null ids, repeated rows, clashing columns; and an empty table."""
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    base = words("a", 60)
    rows = [(1, base), (2, base), (2, base), (None, base), (None, words("n", 30)), (3, None), (3, None), (4, ""), (5, f"password=hunter22 {words('s', 20)}"), (6, words("t", 40)), (7, words("t", 40) + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("lang", "source", "told", "score", "set", "blob", "row"):
        docs = docs.withColumn(c, F.lit("clash"))
    spark.createDataFrame([(1, words("q", 20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(90, 1, 1), (91, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, table in (("odd", docs), ("none", docs.filter("false"))):
        (tmp_path / name).mkdir()
        for t in ("benchmark", "labels"):
            (tmp_path / name / f"{t}.parquet").symlink_to(tmp_path / f"{t}.parquet")
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    assert sorted(repr(r["doc_id"]) for r in got.collect()) == sorted(map(repr, [1, None, 3, 3, 4, 5, 6]))
    assert {"told", "set", "blob", "row", "n_tokens"} <= set(got.columns)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_texts_of_sets_are_fetched_once(spark):
    """Rows that share an id, null included, are not met: as many texts as there are sets that can link."""
    rows = [(None, " ".join(f"t{i // 2}w{k}" for k in range(30)) + " end" * (i % 2)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = df.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("told"), "text")
    wanted = texts.select("id", "told", F.lit(b"").alias("set"), F.col("told").alias("short"))
    assert jaccard_join._held(texts, wanted, True).count() == jaccard_join._held(texts, wanted, False).count() == 2000
    got = jaccard_join.join(df)
    assert got.groupBy("n_links").count().collect() == [(1, 2000)] and got.filter("component_id is null").count() == 2000


def test_slots_of_one_id(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 1500).alias("text"))
    got = kk_sharding.shard(rows).groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.countDistinct("slot").alias("d")).collect()
    assert all((r["lo"], r["hi"], r["d"]) == (0, r["n"] - 1, r["n"]) for r in got) and sum(r["n"] for r in got) == 3000


def test_fit_is_bounded_and_kept(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["vile", "foul"] if i % 2 else ["kind", "good"]) + str(rng.randrange(9)) for _ in range(40))) for i in range(200)] + [(1001, "vile1 " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    net = toxicity.learn(docs, labels, fit_bytes=20_000)
    toxicity.save(net, spark, f"{tmp_path}/net")
    again = toxicity.load(spark, f"{tmp_path}/net")
    scored = lambda n: sorted(map(tuple, toxicity.score(docs, n).select("doc_id", "score").collect()))
    assert scored(net) == scored(again) and all((s >= 0.5) == d % 2 for d, s in scored(net))
    assert toxicity.learn(docs, labels, fit_bytes=10) is None
