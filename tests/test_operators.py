from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vectors as V
from quern.operators import chunking, context, graph, metrics, search, sparse, store, tools
from quern.operators import understanding as U
from quern.plans import evaluation
from quern.plans import pipelines as P
from quern.sources import parsers


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, T.collapse(F.lit("  a\t b\n"))) == "a b"
    assert one(spark, T.words(F.lit("Éa, b_1 한국!"))) == ["éa", "b_1", "한국"]
    assert one(spark, T.sentences(F.lit('One. "Two!" three\nfour'))) == ["One.", '"Two!', "three", "four"]
    assert one(spark, T.snippet(F.lit("x " * 300))).endswith("…")
    assert one(spark, T.stable_id(F.lit("a"), F.lit("b"))) == __import__("hashlib").sha256(b"a\x1fb").hexdigest()[:16]


def test_fusion_golden(spark):
    rows = [("q", "d", "a", 1), ("q", "d", "c", 2), ("q", "s", "b", 1), ("q", "s", "c", 2)]
    got = {r["chunk_id"]: r["score"] for r in search.reciprocal_rank_fusion(spark.createDataFrame(rows, "query_id string, modality string, chunk_id string, rank int")).collect()}
    assert got["c"] == pytest.approx(2 / 62) and got["a"] == pytest.approx(1 / 61) == got["b"]
    rows = [("q", "d", "a", 10.0), ("q", "d", "b", 6.0), ("q", "d", "c", 2.0), ("q", "s", "c", 4.0), ("q", "s", "b", 2.0)]
    got = {r["chunk_id"]: r["score"] for r in search.distribution_fusion(spark.createDataFrame(rows, "query_id string, modality string, chunk_id string, score double")).collect()}
    assert got["a"] == pytest.approx(16 / 24)
    flat = spark.createDataFrame([("q", "d", "a", 5.0), ("q", "d", "b", 5.0)], "query_id string, modality string, chunk_id string, score double")
    assert {r["score"] for r in search.distribution_fusion(flat).collect()} == {0.5}


def test_max_sim_and_mmr(spark):
    docs = spark.createDataFrame([("c1", "alpha beta"), ("c2", "gamma")], "chunk_id string, text string")
    q = spark.createDataFrame([("q", "alpha")], "query_id string, query string")
    rows = search.multi_vectors(docs, "chunk_id", "text").where("chunk_id = 'c2'").collect()
    assert {r["bucket"]: r["w"] for r in rows} == pytest.approx({i: v for i, v in enumerate(search.token_matrix(["gamma"])[0]) if v})
    hits = search.max_sim(q, docs, 5).collect()
    assert hits[0]["chunk_id"] == "c1" and hits[0]["score"] == pytest.approx(1.0) and len(hits) == 2
    rows = spark.createDataFrame([("q", "a", 1.0, 1, "cat dog"), ("q", "b", 0.9, 2, "cat dog"), ("q", "c", 0.5, 3, "cat bird")], "query_id string, chunk_id string, score double, rank int, text string")
    queries = spark.createDataFrame([("q", "cat dog")], "query_id string, query string")
    order = [r["chunk_id"] for r in search.mmr_rerank(rows, queries, 3, 0.3).orderBy("rank").collect()]
    assert order[0] == "a" and order[1] == "c"
    with pytest.raises(ValueError):
        search.mmr_rerank(rows, queries, 3, 2.0)


def test_dense_and_quantised(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("z", [0.0, 0.0])], "chunk_id string, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vec array<double>")
    assert [(r["chunk_id"], round(r["score"], 6)) for r in search.dense_search(q, v, 3).orderBy("rank").collect()] == [("a", 1.0), ("b", 0.6), ("z", 0.0)]
    assert [r["chunk_id"] for r in search.quantised_search(q, v, 2).orderBy("rank").collect()] == ["a", "b"]
    assert one(spark, V.int8(F.array(F.lit(2.5), F.lit(-127.0)))) == [2, -127]
    with pytest.raises(ValueError):
        search.quantised_search(q, v, 2, rescore=0)


def test_hashed_embedding_equals_its_definition(spark):
    df = spark.createDataFrame([("a", "Bravo bravo india"), ("e", "")], "id string, text string")
    got = {(r["id"], r["bucket"]): r["w"] for r in V.hash_embedding(df, "id", "text").collect()}
    want = chunking.hashed("Bravo bravo india")
    assert got == pytest.approx({("a", k): v for k, v in want.items()})


def test_markdown_html_hwpx(spark):
    md = "# Top\n\nText one\nline two\n\n## Sub\n- item\n| a | b |\n|---|---|\n```\ncode\n```\n"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("Contents/section0.xml", "<s xmlns:h='u'><h:p><h:t>Head</h:t></h:p><h:p><h:t>A longer sentence that ends here.</h:t></h:p><h:tbl><h:tr><h:tc>x</h:tc><h:tc>y</h:tc></h:tr></h:tbl></s>")
    rows = [("m", "text/markdown", md, None), ("h", "text/html", "<nav>no</nav><h1>T</h1><p>a &amp; b</p><script>x</script>", None), ("x", "application/hwp+zip", None, buffer.getvalue()), ("p", "text/plain", "a\nb\n\nc", None), ("bad", "image/png", "", None)]
    elements, failures = parsers.parse(spark.createDataFrame(rows, "source_id string, media_type string, text string, content binary"))
    got = {}
    for r in elements.orderBy("source_id", "ord").collect():
        got.setdefault(r["source_id"], []).append((r["type"], r["text"], list(r["section_path"])))
    assert got["m"] == [("Title", "Top", []), ("NarrativeText", "Text one line two", ["Top"]), ("Title", "Sub", ["Top"]), ("ListItem", "item", ["Top", "Sub"]), ("Table", "| a | b |\n|---|---|", ["Top", "Sub"]), ("Code", "code", ["Top", "Sub"])]
    assert got["h"] == [("Title", "T", []), ("NarrativeText", "a & b", ["T"])]
    assert [t[0] for t in got["x"]] == ["Title", "NarrativeText", "Table"] and got["x"][2][1] == "x | y"
    assert [t[1] for t in got["p"]] == ["a b", "c"]
    assert [r["source_id"] for r in failures.collect()] == ["bad"]
    plain = parsers.plain_elements(spark.createDataFrame([("p", "a\nb\n\nc")], "source_id string, text string")).orderBy("ord").collect()
    assert [r["text"] for r in plain] == ["a b", "c"]


def test_chunkers(spark):
    words = " ".join(f"w{i}" for i in range(400))
    e = parsers.plain_elements(spark.createDataFrame([("d", words + "\n\nOne. Two three. Four five.")], "source_id string, text string"))
    c = chunking.heading_aware(e).orderBy("chunk_ord").collect()
    assert [r["token_count"] for r in c] == [180, 180, 125] and c[1]["text"].split()[0] == "w140"
    assert len(c[0]["element_ids"]) == 1 and len(c[2]["element_ids"]) == 2
    p = chunking.propositions(e).collect()
    assert "One." not in [r["text"] for r in p] and "Four five." in [r["text"] for r in p]
    assert chunking.semantic(e).count() >= 2
    h = chunking.hierarchical(chunking.heading_aware(e)).collect()
    assert sum(r["parent_chunk_id"] is not None for r in h) == 3
    with pytest.raises(ValueError):
        chunking.heading_aware(e, 10, 10)


def test_query_understanding(spark):
    ex = lambda q: one(spark, U.expand(F.lit(q)))
    assert ex("backup and backup") == ["backup and backup", "backup"] and ex("a, b, c") == ["a, b, c"] and ex("plain query") == ["plain query"]
    de = lambda q: one(spark, U.decompose(F.lit(q)))
    assert de("Compare solar power with wind power?") == ["What is solar power?", "What is wind power?"]
    assert de("How does inflation affect housing?") == ["What is inflation?", "How does inflation affect housing?"]
    assert de("simple question") == ["simple question"]
    ro = lambda q: one(spark, U.route(F.lit(q)))
    assert (ro("compare a"), ro("1 + 2"), ro("what is the total revenue of acme")) == ("multi_step", "no_retrieval", "single_step")
    assert one(spark, search.permutation(F.lit("[2] > [9] > [2] > [1]"), F.lit(3))) == [1, 0, 2]
    assert one(spark, U.situate(F.lit("T"), F.array(F.lit("T"), F.lit("S")))) == "T › S"


def test_entities_and_graph(spark):
    text = "The deal. Yesterday Alice Smith met Acme Corp. in Paris, then left. Bob said I saw Alice Smith."
    assert one(spark, graph.entities(F.lit(text))) == graph.entities_of(text)
    chunks = spark.createDataFrame([("c1", "Today Alice works at Acme now."), ("c2", "Offices of Acme are in Paris now."), ("c3", "nothing of note")], "chunk_id string, text string")
    mentions, edges = graph.build(chunks)
    hits = {r["chunk_id"]: r["score"] for r in graph.retrieve(spark.createDataFrame([("q", "where does Alice work")], "query_id string, query string"), mentions, edges, 5, iterations=12).collect()}
    assert set(hits) == {"c1", "c2"} and hits["c1"] > hits["c2"] > 0


def test_context_and_answers(spark):
    s = "query_id string, position int, chunk_id string, document_id string, text string, page_span struct<start_page:int,end_page:int>, section_path array<string>, query string"
    rows = [("q", i + 1, f"c{i}", "d", t, (1, 1), [], "alpha beta") for i, t in enumerate(["alpha beta one. Noise here now.", "alpha beta one. Noise here now.", "Other things. beta two."])]
    c = spark.createDataFrame(rows, s)
    kept = context.curate(c)
    assert [r["chunk_id"] for r in kept.orderBy("position").collect()] == ["c0", "c2"]
    assert [r["text"] for r in context.compress(kept).orderBy("position").collect()] == ["alpha beta one.", "beta two."]
    assert [r["position"] for r in spark.range(1, 6).select(context.outward(F.col("id"), F.lit(5)).alias("position")).collect()] == [0, 4, 1, 3, 2]
    q = spark.createDataFrame([("q", "alpha beta"), ("none", "x")], "query_id string, query string")
    a = {r["query_id"]: r for r in context.extractive_answers(q, c).collect()}
    assert a["q"]["answer"].startswith("Based on 3 retrieved passage(s):\n[1] alpha") and a["none"]["answer"] == "" and len(a["q"]["citations"]) == 3
    assert context.unresolved_citations(context.extractive_answers(q, c), c).count() == 0
    prices = spark.createDataFrame([("m-", 1.0, 2.0), ("m-big", 10.0, 20.0)], "prefix string, usd_in double, usd_out double")
    use = spark.createDataFrame([("m-big-1", 4000, 400), ("hash-v1", 400, 4), ("odd", 4, 4)], "model_id string, input_chars int, output_chars int")
    assert {r["model_id"]: r["estimated_cost_usd"] for r in context.cost(use, prices).collect()} == pytest.approx({"m-big-1": 0.012, "hash-v1": 0.0, "odd": 0.0})


def test_metrics(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, metrics.character_error_rate(F.lit("kitten"), F.lit("sitting"))) == 0.5
    assert one(spark, metrics.character_error_rate(F.lit(""), F.lit(""))) == 0.0
    assert one(spark, metrics.answer_correctness(F.lit("a b b"), F.lit("b b c"))) == pytest.approx(2 / 3)
    assert one(spark, metrics.faithfulness(F.lit("a b. x y."), arr("a b c"))) == 0.5
    assert one(spark, metrics.abstention(F.lit("Sorry, I don't know."))) == 1.0
    assert one(spark, metrics.reading_order(arr("a", "b", "c"), arr("a", "c", "b"))) == pytest.approx(2 / 3)
    assert one(spark, metrics.set_f1(arr("a", "b"), arr("b"))) == pytest.approx(2 / 3)
    assert one(spark, metrics.numeric_accuracy(F.lit(100.05), F.lit(100.0))) == 1.0
    assert one(spark, metrics.noise_sensitivity(F.lit("red green. blue sky."), arr("red green car"), F.lit("blue sky"))) == 0.5
    assert one(spark, metrics.operand_found(F.lit(120000000.0), F.lit("매출 1억 2천"))) is False
    assert one(spark, metrics.operand_found(F.lit(1234.0), F.lit("total 1,234 won"))) is True
    null, nan = F.lit(None), F.lit(float("nan"))
    assert [one(spark, metrics.operand_found(v.cast("double"), t.cast("string"))) for v, t in ((null, F.lit("1")), (F.lit(1.0), null), (nan, F.lit("nan")))] == [False] * 3
    cells = one(spark, metrics.table_cells(F.lit("| a | b |\n| c |  |")))
    assert [(c["row"], c["col"], c["text"]) for c in cells] == [(0, 1, "a"), (0, 2, "b"), (1, 1, "c")]


def test_calculator():
    values = {"2 + 3 * 4": 14.0, "10 / 4": 2.5, "2 ** 8": 256.0, "-3 + 5": 2.0, "(3 + 4) * 2 / 7": 2.0, "17 % 5": 2.0, "-2 ** 2": -4.0, "2 ** -3 ** 2": 2.0**-9, "- - 1_000": 1000.0, ".5e1": 5.0}
    assert {e: float(tools.calculate(e)) for e in values} == pytest.approx(values)
    for wrong in ("", "1/0", "1 % 0", "__import__('os')", "x + 1", "'hello'", "3 +* 2", "1 2", "(", ")(", "7 // 2", "9**9**9", "(-8) ** .5", "(" * 5000, "1" * 20_000):
        assert tools.calculate(wrong).startswith("Error")
    turns = iter([tools.Turn(calls=[("1", "calculator", {"expression": "10/4"})]), tools.Turn(text="done")])
    run = tools.run_tools("?", lambda m: next(turns))
    assert run.final_value == 2.5 and run.text == "done" and run.rounds == 2


def test_store(spark, tmp_path):
    st = store.Store(spark, str(tmp_path))
    assert st.read("chunks") is None and st.delete_document("d") == []
    st.upsert("chunks", spark.createDataFrame([("c1", "d", 1), ("c2", "d", 1), ("c3", "e", 1)], "chunk_id string, document_id string, v int"), ["chunk_id"])
    st.upsert("chunks", spark.createDataFrame([("c1", "d", 2)], "chunk_id string, document_id string, v int"), ["chunk_id"])
    assert sorted(map(tuple, st.read("chunks").collect())) == [("c1", "d", 2), ("c2", "d", 1), ("c3", "e", 1)]
    assert [r["chunk_id"] for r in store.pick(st.read("chunks"), ["c3", "no", "c1"]).collect()] == ["c3", "c1"]
    assert st.delete_document("d") == ["c1", "c2"] and st.read("chunks").count() == 1


def sources(spark):
    rows = [("a", "text/markdown", "# Guide\n\nThe Borg backup tool saves data nightly.\n"), ("b", "text/markdown", "# Notes\n\nZetacorp makes widgets in Paris.\n"), ("c", "text/markdown", "# Other\n\nThe guide to gardening and soil.\n")]
    return spark.createDataFrame(rows, "source_id string, media_type string, text string")


@pytest.mark.parametrize("strategy", ["heading_aware", "proposition"])
def test_pipelines_end_to_end(spark, strategy):
    index = P.ingest(sources(spark), P.Settings(chunk_strategy=strategy, contextual=strategy == "heading_aware"))
    q = spark.createDataFrame([(1, "which backup tool saves data"), (2, "hi")], "query_id int, query string")
    a = {r["query_id"]: r for r in P.answer(q, index, P.Settings(top_k=2)).collect()}
    assert "Borg" in a[1]["answer"] and len(a[1]["citations"]) == 2
    ad = {r["query_id"]: r for r in P.adaptive(q, index).collect()}
    assert ad[2]["answer"] == "" and "Borg" in ad[1]["answer"]
    if strategy == "heading_aware":
        assert {r["grade"] for r in P.corrective(q, index).collect()} <= {"correct", "ambiguous", "incorrect"}
        assert "Borg" in P.decomposed(q.where("query_id = 1"), index).first()["answer"]
        assert "Borg" in P.iterative(q.where("query_id = 1"), index, P.Settings(mode="sparse", top_k=1)).first()["answer"]
        for r in ("listwise", "mmr"):
            assert P.answer(q.where("query_id = 1"), index, P.Settings(reranker=r, expand=True, process_contexts=True)).count() == 1


def test_evaluation(spark):
    cases = spark.createDataFrame([("k1", "backup tool", "Borg", "retrieval", "The Borg backup tool."), ("k2", "widgets paris", "Zetacorp", "retrieval", None)], "case_id string, query string, needle string, kind string, reference_answer string")
    rows = evaluation.ablation(sources(spark), cases, {"base": P.Settings(), "context": P.Settings(contextual=True)}, 3)
    got = rows.orderBy("config_ord").collect()
    assert [r["config"] for r in got] == ["base", "context"] and got[0]["recall"] == 1.0
    assert evaluation.best_by(rows, "recall").first()["config"] == "base"
    m = evaluation.run_modes(cases, (i := P.ingest(sources(spark))), evaluation.gold_by_substring(i.chunks, cases), 3, ["sparse", "hybrid"])
    assert {r["mode"] for r in m.collect()} == {"sparse", "hybrid"}


def test_gold_must_be_satisfiable(spark):
    chunks = P.ingest(sources(spark)).chunks
    cases = spark.createDataFrame([("a", "the BORG backup tool saves"), ("b", "soil"), ("c", "paris")], "case_id string, needle string")
    assert sorted(r["case_id"] for r in evaluation.gold_dataset(chunks, cases).collect()) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="unsatisfiable"):
        evaluation.gold_dataset(chunks, cases.unionByName(spark.createDataFrame([("d", "borg backup widgets")], "case_id string, needle string")))
    with pytest.raises(ValueError):
        evaluation.run_matrix(sources(spark), cases, 3, ["nothing"], ["sparse"])


def test_variants_models_and_rankings(spark):
    index = P.ingest(sources(spark))
    q = spark.createDataFrame([(1, "backup tool"), (2, "widgets and gardening soil")], "query_id int, query string")
    plain = {(r["query_id"], r["chunk_id"]): r["score"] for r in P.retrieve(q, index, P.Settings(top_k=3)).collect()}
    more = {(r["query_id"], r["chunk_id"]): (r["score"], r["components"]) for r in P.retrieve(q, index, P.Settings(top_k=3, expand=True)).collect()}
    assert {k: v for k, v in plain.items() if k[0] == 1} == {k: v[0] for k, v in more.items() if k[0] == 1}  # one variant: plain hits
    assert all(v[1] for k, v in more.items() if k[0] == 1) and not any(v[1] for k, v in more.items() if k[0] == 2)
    hyde = P.retrieve(q.where("query_id = 1"), index, P.Settings(top_k=1, expand=True, mode="sparse", hypothesis=lambda c: F.lit("zetacorp makes widgets"))).collect()
    assert len(hyde) == 1 and hyde[0]["score"] == pytest.approx(1 / 61)
    said = P.answer(q, index, P.Settings(top_k=2, mode="sparse", order=lambda query, texts: [1, 0], generator=lambda query, contexts: F.concat(query, F.lit(" / "), F.size(contexts).cast("string")))).collect()
    first = {r["query_id"]: r["chunk_id"] for r in P.retrieve(q, index, P.Settings(top_k=2, mode="sparse")).where("rank = 1").collect()}
    for r in said:
        assert r["answer"] == r["query"] + " / 2" and r["retrieved_ids"][0] == first[r["query_id"]] == r["citations"][1]["chunk_id"]
    hits = search.identity_rerank(P.retrieve(q, index, P.Settings(top_k=2)), 2).first()
    assert set(hits["components"]) == {"dense", "sparse", "rerank"}
    embedded = P.ingest(sources(spark), P.Settings(embedder=lambda t: F.array(F.contains(F.lower(t), F.lit("borg")).cast("double"), F.lit(0.1).cast("double"))))
    best = P.retrieve(spark.createDataFrame([(1, "borg")], "query_id int, query string"), embedded, P.Settings(mode="dense", top_k=1, embedder=lambda t: F.array(F.lit(1.0), F.lit(0.0)))).join(embedded.chunks, "chunk_id").first()
    assert "Borg" in best["text"]


def test_search_of_many_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    v = spark.createDataFrame([(f"c{i}", [float(i), 1.0]) for i in range(20)], "chunk_id string, vec array<double>")
    q = spark.createDataFrame([(i, [1.0, float(-i)]) for i in range(10)], "query_id int, vec array<double>")
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in search.dense_search(q, v, 2, "dot").collect()}
    assert len(got) == 20 and all(got[i, 1] == "c19" and got[i, 2] == "c18" for i in range(10))


def test_layout_headings(spark):
    rows = [("heading", "A", 1), ("paragraph", "one", None), ("heading", "B", 2), ("list", "two", None), ("chart", "three", None), ("heading", "C", 2), ("table", "four", None), ("heading", "D", 1), ("odd", "five", None), ("paragraph", "  ", None)]
    items = spark.createDataFrame([("d", "s", i, t, c, h) for i, (t, c, h) in enumerate(rows)], "document_id string, source_id string, ord int, type string, content string, heading_level int")
    items = items.select("document_id", "source_id", "ord", F.to_json(F.struct("type", "content", "heading_level", F.lit(2).alias("page_number"))).alias("json"))
    got = [(r["type"], r["text"], r["section_path"], r["start_page"]) for r in parsers.layout_elements(items).orderBy("ord").collect()]
    assert got == [
        ("Title", "A", [], 2), ("NarrativeText", "one", ["A"], 2), ("Title", "B", ["A"], 2), ("ListItem", "two", ["A", "B"], 2), ("Figure", "three", ["A", "B"], 2),
        ("Title", "C", ["A"], 2), ("Table", "four", ["A", "C"], 2), ("Title", "D", [], 2), ("NarrativeText", "five", ["D"], 2),
    ]
    with pytest.raises(ValueError):
        parsers.layout_elements(items, "other")


def test_graph_batches_add_up(spark):
    a = spark.createDataFrame([("c1", "Today Alice works at Acme now.")], "chunk_id string, text string")
    b = spark.createDataFrame([("c2", "Here Alice left Acme and Paris.")], "chunk_id string, text string")
    mentions, edges = graph.merged(graph.build(a), graph.build(b))
    whole = graph.build(a.unionByName(b))
    assert sorted(map(tuple, mentions.collect())) == sorted(map(tuple, whole[0].collect())) and sorted(map(tuple, edges.collect())) == sorted(map(tuple, whole[1].collect()))


def test_bm25_of_nothing(spark):
    empty = spark.createDataFrame([], "chunk_id string, text string")
    assert sparse.encode(empty, sparse.fit(empty)).count() == 0
