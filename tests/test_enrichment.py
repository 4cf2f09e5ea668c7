"""Enrichment, what outlives a run, and documents saved one by one."""

import json
import os
import tempfile
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import SF
from loomgraph.functions.canonical import quoted
from loomgraph.operators import enrichment, stores
from loomgraph.plans import enriching
from loomgraph.sources import files


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_strings_as_json_has_them(spark):
    texts = ["", "plain", 'a "quote" \\ slash/', "tab\t line\n cr\r bs\b ff\f nul\x00 us\x1f del\x7f", "Ünï ß 日本", "astral 😀 end", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(quoted(F.col("t")).alias("q")).collect()
    assert [r["q"] for r in got] == [None if t is None else json.dumps(t) for t in texts]


def test_keys_are_those_of_canonical_json(spark):
    import hashlib

    rows = [("m-1", "1", '{"a":1}'), ("mö", "2", "[]"), ("m-1", "1", '{"a":2}')]
    got = spark.createDataFrame(rows, "m string, v string, p string").select(enrichment.key_of(F.col("m"), F.col("v"), F.col("p")).alias("k")).collect()
    want = [hashlib.sha256(json.dumps([m, v, json.loads(p)], sort_keys=True, separators=(",", ":")).encode()).hexdigest() for m, v, p in rows]
    assert [r["k"] for r in got] == want and len(set(want)) == 3


# ------------------------------------------------------------------ stores


def test_replies_are_replaced_by_key(spark, folder):
    store = stores.KeyedStore(spark, f"{folder}/r", "key string, response string, stored_at timestamp", parts=4)
    assert store.rows().count() == 0
    at = datetime(2026, 1, 1)
    put = lambda *rows: store.put(spark.createDataFrame([(k, v, at + timedelta(hours=h)) for k, v, h in rows], "key string, response string, stored_at timestamp"))
    held = lambda: {r["key"]: r["response"] for r in store.rows().collect()}
    put(*[(f"k{i}", "old", 1) for i in range(20)])
    put(("k3", "new", 2), ("k4", "late", 0), ("k5", "again", 1), ("k99", "first", 5))
    assert held() == {f"k{i}": "old" for i in range(20)} | {"k3": "new", "k5": "again", "k99": "first"}
    put()
    put(("k3", "new", 2))  # a second time changes nothing
    assert len(held()) == 21 and store.rows().count() == 21


def test_a_put_that_dies_leaves_the_store_as_it_was(spark, folder):
    store = stores.KeyedStore(spark, f"{folder}/r", "key string, response string, stored_at timestamp", parts=4)
    rows = spark.createDataFrame([(f"k{i}", "old", datetime(2026, 1, 1)) for i in range(9)], "key string, response string, stored_at timestamp")
    store.put(rows)

    @F.udf("string")
    def failing(k):
        if k == "k7":
            raise RuntimeError("lost")
        return "new"

    with pytest.raises(Exception, match="lost"):
        store.put(rows.withColumn("response", failing("key")))
    assert {r["response"] for r in store.rows().collect()} == {"old"} and store.rows().count() == 9


def test_ledger_keeps_thirty_days(spark, folder):
    ledger = stores.Ledger(spark, f"{folder}/l", limit=50)
    first = date(2026, 1, 1)
    calls = lambda **days: spark.createDataFrame([(first + timedelta(days=int(d[1:])), n) for d, n in days.items()], "day date, calls long")
    held = lambda d: {(r["day"] - first).days: r["calls"] for r in ledger.used(first + timedelta(days=d)).collect()}
    assert ledger.remaining(first) == 50
    ledger.record(calls(d0=3, d1=4), first + timedelta(days=1))
    ledger.record(calls(d1=5), first + timedelta(days=1))
    assert held(1) == {0: 3, 1: 9} and ledger.remaining(first + timedelta(days=1)) == 41
    ledger.record(calls(d31=1), first + timedelta(days=31))
    assert held(31) == {1: 9, 31: 1}
    ledger.record(calls(d33=2, d0=7), first + timedelta(days=33))  # stands where day 1 stood; day 0 is too old
    assert held(33) == {31: 1, 33: 2}
    assert spark.read.parquet(f"{folder}/l").where(F.col("day") == F.lit(first + timedelta(days=1))).count() == 0
    ledger.check(48, first + timedelta(days=33))
    with pytest.raises(stores.BudgetExceeded):
        ledger.check(49, first + timedelta(days=33))


# ------------------------------------------------------------------ enrichment


def test_a_second_run_calls_nothing(spark, folder):
    first = enriching.run_enrichment(spark, SF, folder)
    assert first.calls == first.batches > 10 and first.hits == 0
    reasons = {r["reason"]: r["count"] for r in first.skipped.groupBy("reason").count().collect()}
    assert set(reasons) == {"truncated", "not in the reply"}
    lost = first.skipped.where("reason = 'truncated'").select("doc_id", "batch").distinct().count()
    second = enriching.run_enrichment(spark, SF, folder)
    assert (second.calls, second.hits) == (lost, first.batches - lost)  # what was no reply is asked again
    assert sorted(map(repr, second.contexts.collect())) == sorted(map(repr, first.contexts.collect()))
    nodes = enriching.described(spark, SF).count()
    assert first.contexts.count() + first.skipped.count() == nodes
    ledger = stores.Ledger(spark, f"{folder}/ledger", 1 << 40)
    assert [r["calls"] for r in ledger.used(date(2026, 1, 2)).collect()] == [first.calls + second.calls]
    assert {r["version"] for r in first.versions.collect()} == {"1.1"}


def test_dry_runs_and_budgets_call_nothing(spark, folder):
    plan = enrichment.planned(enriching.described(spark, SF), "own", limit=1)
    cache = stores.replies(spark, f"{folder}/replies")

    def never(request):
        raise AssertionError("called")

    n = plan.count()
    assert enrichment.enriched(plan, cache) == {"batches": n, "calls": n, "hits": 0}
    with pytest.raises(stores.BudgetExceeded):
        enrichment.enriched(plan, cache, stores.Ledger(spark, f"{folder}/ledger", n - 1), never, date(2026, 1, 2))
    assert not os.path.exists(f"{folder}/ledger") and not os.path.exists(f"{folder}/replies")


def test_equal_requests_are_sent_once(spark, folder):
    plan = spark.createDataFrame([(d, 0, ["n0"], "[same]", "k") for d in range(5)], "doc_id long, batch long, ids array<string>, request string, key string")
    log = f"{folder}/log"

    def client(request):
        with open(log, "a") as f:
            f.write("x")
        return '{"nodes": {"n0": {"summary": "s"}}}', "stop"

    found = enrichment.enriched(plan, stores.replies(spark, f"{folder}/r"), None, client, date(2026, 1, 2), datetime(2026, 1, 2))
    assert found.contexts.count() == 5 and found.calls == 1 and open(log).read() == "x"


def test_contexts_take_what_was_asked_for(spark):
    long = "x" * 300
    payloads = [
        {"summary": " ok ", "intent": 5, "invariants": ["a", 2, 2.5, True, "", {"x": 1}, None, long], "side_effects": "none", "failure_modes": ["plain", {"description": " told ", "handled": True}, {"about": "x"}, 7], "confidence": "0.456"},
        {"summary": long, "confidence": 9}, {"intent": "why", "confidence": None}, {"summary": "  ", "invariants": [], "failure_modes": [""]}, {},
    ]
    rows = spark.createDataFrame([(1, 0, f"n{i}", json.dumps(p)) for i, p in enumerate(payloads)], "doc_id long, batch long, id string, p string")
    got = {r["id"]: r.asDict() for r in enrichment.contexts(rows.withColumn("payload", F.parse_json("p"))).collect()}
    assert set(got) == {"n0", "n1", "n2"}
    n = got["n0"]
    assert (n["summary"], n["intent"], n["invariants"], n["side_effects"], n["failure_modes"], n["confidence"]) == (" ok ", None, ["a", "2", "2.5", "True", "x" * 200], None, ["plain", "told"], 0.46)
    assert (got["n1"]["summary"], got["n1"]["confidence"]) == ("x" * 200, 1.0)
    assert (got["n2"]["intent"], got["n2"]["confidence"]) == ("why", 0.5)


def test_overwriting_asks_about_all_nodes(spark):
    nodes = spark.createDataFrame([(1, 0, "a", "agent", None, None, True), (1, 1, "b", "agent", "B", None, None)], "doc_id long, ord long, id string, type string, name string, ref string, has_context boolean")
    registry = spark.createDataFrame([], "doc_id long, registry string, ord long, id string")
    edges = spark.createDataFrame([(1, 0, "a", "passes", "b"), (1, 1, "b", "calls", "lost")], "doc_id long, ord long, source string, type string, target string")
    got = lambda overwrite: {r["id"]: json.loads(r["description"]) for r in enrichment.described(nodes, registry, edges, overwrite).collect()}
    assert got(False) == {"b": {"id": "b", "type": "agent", "name": "B", "incoming": ["a --passes-->"], "outgoing": ["--calls--> lost"]}}
    assert set(got(True)) == {"a", "b"}


# ------------------------------------------------------------------ files


def test_a_file_for_each_document(spark, folder):
    docs = spark.createDataFrame([(i, json.dumps({"n": i, "t": "é"})) for i in range(7)], "doc_id long, raw string").repartition(3)
    files.save(docs, f"{folder}/out")
    assert sorted(os.listdir(f"{folder}/out")) == [f"{i}.json" for i in range(7)]
    assert open(f"{folder}/out/3.json").read() == '{\n  "n": 3,\n  "t": "é"\n}\n'
    files.save(docs.where("doc_id > 4"), f"file://{folder}/out", overwrite=True)
    assert {r["name"]: json.loads(r["raw"])["n"] for r in files.saved(spark, f"{folder}/out").collect()} == {"5": 5, "6": 6}


def test_a_failing_task_leaves_no_file(spark, folder):
    good = spark.createDataFrame([(1, '{"a": 1}')], "doc_id long, raw string")
    files.save(good, f"{folder}/out")
    bad = spark.createDataFrame([(2, '{"b": 2}'), (3, "no json"), (1, '{"a": 9}')], "doc_id long, raw string").repartition(3, "doc_id")
    with pytest.raises(Exception, match="JSON|Expecting"):
        files.save(bad, f"{folder}/out", overwrite=True)
    assert os.listdir(f"{folder}/out") == ["1.json"] and json.load(open(f"{folder}/out/1.json")) == {"a": 1}
