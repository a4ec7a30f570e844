"""Runs share what they have in common; parser scores and guarded cases against brute force."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import metrics as M
from quern.plans import evaluation as E
from quern.plans import pipelines as P
from quern.plans.tables import folder

SOURCES = [
    ("a", "text/markdown", "# Guide\n\nThe Borg backup tool saves data nightly. It runs on every host.\n"),
    ("b", "text/markdown", "# Notes\n\nZetacorp makes widgets in Paris. They sell them abroad.\n"),
    ("c", "text/markdown", "# Other\n\nThe guide to gardening and soil, which Paris likes.\n"),
]
CASES = [("k1", "backup tool", "Borg", "The Borg backup tool."), ("k2", "widgets in paris", "Zetacorp", None), ("k3", "soil", "gardening", None)]


@pytest.fixture(scope="module")
def given(spark):
    return spark.createDataFrame(SOURCES, "source_id string, media_type string, text string"), spark.createDataFrame(CASES, "case_id string, query string, needle string, reference_answer string")


def tables(spark, name):
    path = folder(spark) + "/quern-tables"
    return sum(f.startswith(name + "-") for f in os.listdir(path)) if os.path.isdir(path) else 0


def test_configurations_share_indexes_gold_and_hits(spark, given):
    sources, cases = given
    configs = {
        "base": P.Settings(mode="sparse"), "dense": P.Settings(mode="dense"), "mmr": P.Settings(mode="sparse", reranker="mmr"),
        "context": P.Settings(mode="sparse", contextual=True), "small": P.Settings(mode="sparse", chunk_strategy="proposition"),
    }
    before = {n: tables(spark, n) for n in ("outlines", "postings", "gold", "hits")}
    rows = E.ablation(sources, cases, configs, 2)
    made = {n: tables(spark, n) - before[n] for n in before}
    assert made == {"outlines": 1, "postings": 3, "gold": 2, "hits": 4}
    got = {r["config"]: r.asDict() for r in rows.collect()}
    assert [r["config"] for r in sorted(got.values(), key=lambda r: r["config_ord"])] == [*configs]
    alone = E.ablation(sources, cases, {"context": configs["context"]}, 2).first().asDict()
    assert {**alone, "config_ord": 3} == got["context"]
    assert got["base"]["recall"] == 1.0 and got["base"]["answer_correctness"] is not None
    assert E.best_by(rows, "recall").first()["config"] == "base"


def test_profile_is_each_ablation_and_the_means_over_all_cases(spark, given):
    sources, cases = given
    scenarios = {"all": (sources, cases), "one": (sources.where("source_id <> 'b'"), cases.where("case_id <> 'k2'")), "lost": (sources.where("source_id = 'c'"), cases.where("case_id = 'k1'"))}
    configs = {"sparse": P.Settings(mode="sparse"), "dense": P.Settings(mode="dense")}
    rows = E.profile(scenarios, configs, 1)
    got = {(r["scenario"], r["config"]): r for r in rows.collect()}
    assert len(got) == 8
    for r in E.ablation(*scenarios["one"], configs, 1).collect():
        assert got["one", r["config"]]["mrr"] == pytest.approx(r["mrr"]) and got["one", r["config"]]["faithfulness"] == pytest.approx(r["faithfulness"])
    sizes = {"all": 3, "one": 2, "lost": 1}
    for config in configs:
        assert got[None, config]["recall"] == pytest.approx(sum(n * got[s, config]["recall"] for s, n in sizes.items()) / 6)
    won = {r["config"]: r["scenarios"] for r in E.strengths(rows, "mrr").collect()}
    assert sorted(s for l in won.values() for s in l) == ["all", "lost", "one"] and "lost" in won["sparse"]  # the first of equal ones
    wide = {r["scenario"]: r for r in E.profile_table(rows, "mrr", [*configs]).collect()}
    assert wide["lost"]["sparse"] == wide["lost"]["dense"] == 0.0 and wide["lost"]["best"] == "sparse"


def test_matrix_of_strategies_and_modes(spark, given):
    sources, cases = given
    got = {(r["strategy"], r["mode"]): r for r in E.run_matrix(sources, cases, 2, ["heading_aware", "proposition"], ["sparse", "dense"]).collect()}
    assert len(got) == 4
    assert all(got[s, "sparse"]["faithfulness"] == got[s, "dense"]["faithfulness"] for s in ("heading_aware", "proposition"))
    index = P.ingest(sources, P.Settings(chunk_strategy="proposition"))
    alone = E.run_modes(cases, index, E.gold_by_substring(index.chunks, cases), 2, ["sparse"]).first()
    assert got["proposition", "sparse"]["ndcg"] == pytest.approx(alone["ndcg"])


def test_reading_order_counts_swapped_pairs(spark):
    rng = random.Random(3)
    gold, found = [], []
    for doc, n in enumerate((0, 1, 2, 3, 8, 33, 200)):
        gold += [(doc, f"e{i}", rng.randint(0, n)) for i in range(n)]
        found += [(doc, f"e{i}", rng.randint(0, n)) for i in range(0, 2 * n, 2)]  # ties, and keys that gold lacks
    rows = M.order_scores(spark.createDataFrame(gold, "doc int, key string, at int"), spark.createDataFrame(found, "doc int, key string, at int"), ["doc"], "key", "at").collect()
    got = {r["doc"]: (r["n"], r["reading_order"]) for r in rows}
    for doc in range(7):
        g, f = ({k: (p, k) for d, k, p in rows_ if d == doc} for rows_ in (gold, found))
        common = sorted(g.keys() & f.keys(), key=g.get)
        pairs = [f[a] < f[b] for i, a in enumerate(common) for b in common[i + 1 :]]
        if not pairs:
            assert doc not in got
        else:
            assert got[doc] == (len(common), pytest.approx(sum(pairs) / len(pairs)))


def test_parser_scores_of_missing_empty_and_repeated_elements(spark):
    gold = spark.createDataFrame([("d", 1, 0, "Title"), ("d", 2, 1, "Table"), ("d", 3, 2, "NarrativeText"), ("e", 1, 0, "Title"), ("f", 1, 0, None)], "document_id string, element int, ord int, type string")
    cells = spark.createDataFrame([("d", 0, 0, "a"), ("d", 0, 1, "b"), ("g", 0, 0, "z")], "document_id string, row int, col int, text string")
    parsed = spark.createDataFrame(
        [("p", "d", 3, 0, "Title", "x"), ("p", "d", 3, 4, "NarrativeText", "x"), ("p", "d", 1, 1, "Title", "t"), ("p", "d", 2, 2, "Table", "a | c\n | "), ("p", "d", 9, 3, "Table", None), ("p", "h", 1, 0, "Title", "t")],
        "parser string, document_id string, element int, ord int, type string, text string",
    )
    got = {(r["parser"], r["document_id"]): (r["type_accuracy"], r["reading_order"], r["table_f1"]) for r in M.parser_scores(parsed, gold, cells, ["p", "q"]).collect()}
    assert got["p", "d"] == (1.0, pytest.approx(1 / 3), 0.5)  # 3 is first: of its pairs both are swapped
    assert got["q", "d"] == (0.0, 1.0, 0.0) and got["p", "e"] == (0.0, 1.0, 1.0) and got["p", "f"] == (0.0, 1.0, 1.0) and got["p", "g"] == (1.0, 1.0, 0.0)
    assert {d for _, d in got} == {"d", "e", "f", "g"} and M.parser_scores(parsed.limit(0), gold.limit(0), cells.limit(0), ["p"]).count() == 0


def test_guarded_cases(spark):
    chunks = spark.createDataFrame([("x", "sales of 1,234 and 12만 units"), ("y", "the rate is 3.5 percent"), ("z", None)], "chunk_id string, text string")
    rows = [
        ("ok", "computation", ["y", "x", "gone"], [1234.0, 120000.0, 3.5], "1234 * 3.5"), ("made up", "computation", ["x"], [1234.0, 99.0], "1234 + 99"), ("elsewhere", "computation", ["y"], [1234.0], "1234"),
        ("broken", "computation", ["x"], [1234.0], "1234 / 0"), ("no operation", "computation", ["x"], None, None), ("empty operation", "computation", ["x"], [], ""), ("null number", "computation", ["x"], [None], "1"),
        ("found", "retrieval", ["y", "y"], [77.0], "1 + 1"), ("kind", "essay", ["x"], None, None), ("lost", "table", ["gone"], None, None), ("no ids", "table", None, None, None), ("no text", "table", ["z"], None, None), ("no kind", None, ["x"], None, None),
        ("no text at all", "computation", ["z"], [1.0], "1"),
    ]
    got = {r["case_id"]: r for r in E.guarded_cases(spark.createDataFrame(rows, "case_id string, kind string, chunk_ids array<string>, numbers array<double>, operation string").withColumn("query", F.lit("q")), chunks).collect()}
    assert set(got) == {"ok", "no operation", "empty operation", "found", "no text"}
    assert got["ok"]["expected_value"] == 4319.0 and got["ok"]["formula"] == "1234 * 3.5" and got["ok"]["chunk_ids"] == ["y", "x"] and len(got["ok"]["numbers"]) == 3
    assert got["no operation"]["expected_value"] is None is got["empty operation"]["formula"] and got["found"]["chunk_ids"] == ["y", "y"] and got["found"]["numbers"] == [] and got["found"]["expected_value"] is None
