from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import chunking
from quern.plans import evaluation
from quern.sources import parsers


def spans(text):
    out, at = [], 0
    for end, after in [*((m.start(), m.end()) for m in re.finditer(r"(?<=[.!?])[\"')\]]?\s+|\n+", text)), (len(text), len(text))]:
        if body := text[at:end].strip():
            begin = at + text[at:end].index(body)
            out.append((body, begin, begin + len(body)))
        at = after
    return out


def vector(text):
    out = Counter()
    for t in re.findall(r"\w+", text.lower()):
        d = hashlib.sha1(t.encode()).digest()
        out[int.from_bytes(d[:4], "big") % 256] += 1 if d[4] & 1 else -1
    return out


def plain_cuts(text, percentile, most):
    s = spans(text)
    v = [vector(x[0]) for x in s]
    size = [sum(x * x for x in c.values()) for c in v]
    gaps = [1.0 - (sum(x * b[k] for k, x in a.items()) / np.sqrt(float(m * n)) if m * n else 0.0) for a, b, m, n in zip(v, v[1:], size, size[1:], strict=False)]
    limit = float(np.percentile(gaps, percentile)) if gaps else 0.0
    cuts, held = [0], len(s[0][0].split())
    for i, gap in enumerate(gaps, 1):
        n = len(s[i][0].split())
        if gap > limit or held + n > most:
            cuts.append(i)
            held = 0
        held += n
    return [(s[a][1], s[b - 1][2]) for a, b in zip(cuts, [*cuts[1:], len(s)], strict=True)]


def prose(rng, n):
    return "".join(rng.choice(["alpha beta", "gamma", 'delta "x', "eps", "42", "Zeta eta theta"]) + rng.choice([". ", '." ', "! ", "?\n", ".\n\n", ", ", ".) ", " ... "]) for _ in range(n))


def elements(spark, rng, n=25):
    rows = [(f"d{i}", j, rng.choice(["NarrativeText", "NarrativeText", "Title"]), prose(rng, rng.randint(1, 30)).strip(), [f"s{j // 4}"]) for i in range(n) for j in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "document_id string, ord int, type string, text string, section_path array<string>")
    return df.withColumns({"source_id": F.col("document_id"), "element_id": F.concat("document_id", F.lit("-"), "ord"), "start_page": F.col("ord") + 1, "end_page": F.col("ord") + 1}).repartition(3)


@pytest.mark.parametrize(("percentile", "most"), [(90.0, 180), (50.0, 12), (99.0, 3)])
def test_semantic_cuts(spark, percentile, most):
    e = elements(spark, random.Random(int(percentile)))
    texts = {(r["document_id"], r["section_ord"]): r["text"] for r in chunking.sections(e).collect()}
    got = {}
    for r in chunking.semantic(e, percentile, most).orderBy("chunk_ord").collect():
        got.setdefault((r["document_id"], r["section_ord"]), []).append((r["char_start"], r["char_end"]))
        assert r["text"] == texts[r["document_id"], r["section_ord"]][r["char_start"] : r["char_end"]] and r["element_ids"]
    assert got == {k: plain_cuts(t, percentile, most) for k, t in texts.items() if spans(t)}


def test_sentences_and_their_elements(spark):
    e = elements(spark, random.Random(8))
    parts = {(r["document_id"], r["section_ord"]): (r["text"], r["parts"]) for r in chunking.sections(e).collect()}
    rows = chunking.propositions(e, skip_single_word=False).collect()
    got = {}
    for r in rows:
        got.setdefault((r["document_id"], r["section_ord"]), []).append((r["chunk_ord"], r["text"], r["char_start"], r["char_end"]))
        hit = [p for p in parts[r["document_id"], r["section_ord"]][1] if p["start"] < r["char_end"] and r["char_start"] < p["end"]]
        assert r["element_ids"] == [p["element_id"] for p in hit] and r["page_span"]["start_page"] == min(p["start_page"] for p in hit)
    assert {k: sorted(v) for k, v in got.items()} == {k: [(i, *s) for i, s in enumerate(spans(t))] for k, (t, _) in parts.items()}


def test_sentence_chunkers_run_without_python(spark):
    e = parsers.plain_elements(spark.createDataFrame([("d", "One two. Three.")], "source_id string, text string"))
    for chunks in (chunking.semantic(e), chunking.propositions(e)):
        plan = chunks._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "NestedLoop", "Cartesian"))
    none = e.where("false")
    assert chunking.semantic(none).count() == chunking.propositions(none).count() == 0


def test_gold_by_every_kind_of_needle(spark):
    rng = random.Random(6)
    texts = {f"c{i}": prose(rng, 12).upper() if i % 3 else prose(rng, 3) for i in range(40)} | {"none": None, "empty": "", "odd": "ab\n漢字 x"}
    needles = [None, "", "a", "Et", "LPH", "gamma", "alpha beta", "eta theta. ga", "x. ", "nowhere at all", "漢字", "b\n漢", "delta \"x! eps", "zzz", "  "]
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, text string").repartition(3)
    cases = spark.createDataFrame([(f"n{i}", n) for i, n in enumerate(needles)] + [("n3", "Et")], "case_id string, needle string")
    gold = evaluation.gold_by_substring(chunks, cases)
    got = sorted((r["case_id"], r["chunk_id"]) for r in gold.collect())
    assert got == sorted((f"n{i}", c) for i, n in enumerate(needles) if n is not None for c, t in texts.items() if t is not None and n.lower() in t.lower())
    plan = gold._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
