"""Toxicity, Merkle manifest and source divergence against plain definitions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import divergence, merkle, toxicity

random.seed(11)
SYLLABLES = ["ka", "Lo", "mi", "ren", "tas", "vu", "É", "pol", "ist", "qua"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, run int, rank int"


def prose(n: int, parts: int = 3) -> str:
    return " ".join("".join(random.choice(SYLLABLES) for _ in range(random.randint(1, parts))) for _ in range(n))


def documents(spark, n: int = 160):
    rows = []
    for i in range(n):
        text = random.choice([None, "", "12 [x]", prose(random.randint(1, 60), 2), "the_the-The " * 3, "한국어 É é\x1cz {ü}"])
        rows.append((random.choice([i, i, 7, None]), text, random.choice(["en", "en", "en", "fr", "", None, "zz"]), random.choice(["a", "a", "b", "ü", None, ""]), random.choice([None, i]), "x", 3, 4))
    rows += [rows[3]] * 40 + [(900, "alone", "one", "a", 5, "x", 3, 4)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def plain_manifest(rows):
    def leaf(r, more=0):
        values = (r[c] + more if c == "n_chars" and r[c] is not None else r[c] for c in merkle.FIELDS)
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
        return levels

    def way(levels, i):
        for nodes in levels[:-1]:
            yield (nodes[i ^ 1] if i ^ 1 < len(nodes) else ""), i & 1
            i >>= 1

    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = [*way(trees[g], i), *way(top, k)]
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node = leaf(r, int(tampered))
            for sibling, left in path:
                node = sha(sibling + node if left else node + sibling)
            yield r["doc_id"], leaf(r), trees[g][-1][0], top[-1][0], sha("".join(s for s, _ in path)), node, node == top[-1][0]


@pytest.mark.parametrize("levels", [10, 3, 1])
def test_merkle_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    df = documents(spark)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in merkle.manifest_digest(df).collect()), key=key) == sorted(plain_manifest(df.collect()), key=key)


def test_merkle_manifest_of_few_rows(spark):
    df = documents(spark)
    assert merkle.manifest_digest(df.where("false")).count() == 0
    (one,) = merkle.manifest_digest(df.where("doc_id = 900")).collect()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == sha("")
    same = df.where("doc_id = 900").select("doc_id", "text", "lang", "source", "n_chars").crossJoin(spark.range(900)).drop("id")
    assert sorted(tuple(r) for r in merkle.manifest_digest(same).collect()) == sorted(plain_manifest(same.collect()))  # one key only
    with pytest.raises(ValueError):
        merkle.manifest(df.withColumnRenamed("doc_id", "pos"), "lang", ["pos"], F.lit("a"), F.lit("a"))


def plain_audit(rows):
    found, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for r in rows:
        lang, source = r["lang"] or "", r["source"] or ""
        t = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r["text"] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        groups[lang].add(source)
        found[lang, source].update(t)
        docs[lang].update(set(t))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= 3)
        whole = Counter({t: sum(found[lang, s][t] for s in sources) for t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p, q = {s: share(found[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            own = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if found[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", own, 200)):
                for k, (v, i) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.add((lang, s, part, i, v, k + 1))
    return out


@pytest.mark.parametrize("limits", [{}, {"PAIRS": 3, "HELD": 10, "SALTS": 2}])
def test_source_divergence(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(divergence, name, value)
    df = documents(spark)
    got = [tuple(r) for r in divergence.audit(df).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(df.collect())
    assert divergence.audit(df.where("false")).count() == 0


def test_shares_of_large_counts(spark):
    cases = [(0, 1), (0, 3), (5, 7), (8_999_999_999_999, 9_000_000_000_000), (10**12, 8 * 10**14 + 1), (123_456_789_012, 987_654_321_098_765)]
    got = spark.createDataFrame(cases, "c long, t long").selectExpr(f"{divergence.share('c', 't')} AS p").collect()
    assert [r["p"] for r in got] == [1 + 10**9 * (c + 1) // t for c, t in cases]


RUDE = ["idiot", "moron", "scum", "trash", "loser"]


def labelled(spark, n: int = 600):
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = prose(30).lower() + " " + " ".join([random.choice(RUDE) if i % 2 else "grob" + prose(1, 1).lower() for _ in range(3)] if toxic else [])
        docs.append((i, text, "en", "s", 1, "x", 3, 4))
        if i % 3:
            labels.append((i, int(toxic), 1))
    return spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int, score int")


def test_toxicity_of_held_out_texts(spark):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in toxicity.assess(docs, labels).collect()}
    assert len(got) == 600 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert np.mean([r["predicted"] == int(i % 5 == 0) for i, r in got.items() if r["held_out"]]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert all(e["toxic_share"] > 0.5 for r in got.values() if r["predicted"] for e in r["evidence"][:1])
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r["doc_id"]: r["score"] for r in toxicity.assess(docs, flipped).collect()} == {i: r["score"] for i, r in got.items()}  # held-out labels teach nothing


def test_nearest_examples_equal_all_cosines():
    rng = np.random.default_rng(3)
    examples = []
    for i in range(700):
        at = np.flatnonzero(rng.random(40) < rng.choice([0.0, 0.05, 0.3]))
        examples.append((tuple(at.tolist()), tuple(rng.integers(1, 4, len(at)).tolist()), int(rng.random() < 0.2), i))
    own = toxicity.index(examples, rng.integers(1, 500, 40), 1000, {0: 1.0, 1: 1.0})
    dense = np.zeros((len(own.keys), 40))
    for i, (at, times) in enumerate(own.keys):
        dense[i, list(at)] = own.weigh(np.array(at, int), np.array(times, float))
    assert len(own.blocks) > 3
    asked, but = [], []
    for _ in range(150):
        at = np.flatnonzero(rng.random(40) < 0.1)
        asked.append((at, own.weigh(at, rng.integers(1, 4, len(at)).astype(float))))
        but.append(int(rng.integers(-1, len(own.keys))))
    for (at, w), b, (near, got) in zip(asked, but, toxicity.nearest(own, asked, 7, but), strict=True):
        sims = np.round(dense[:, at] @ w, 9)
        if b >= 0:
            sims[b] = 0
        want = sorted((-s, i) for i, s in enumerate(sims) if s > 0)
        want = [x for x in want if len(want) <= 7 or x[0] <= want[6][0]]
        assert near.tolist() == [i for _, i in want] and np.allclose(got, [-s for s, _ in want])
    assert own.visited < 150 * len(own.blocks)


def test_toxicity_of_odd_tables(spark):
    docs, labels = labelled(spark, 60)
    odd = docs.unionByName(documents(spark, 40))
    rows = toxicity.assess(odd, labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0), (7, 0, 0), (7, 1, 0)], labels.schema))).collect()
    assert len(rows) == odd.count() and len({r["score"] for r in rows if r["doc_id"] is None}) >= 1
    assert toxicity.assess(docs.where("false"), labels).count() == 0
    assert {r["score"] for r in toxicity.assess(docs, labels.where("false")).collect()} == {0.0}
    assert {r["predicted"] for r in toxicity.assess(docs, labels.where("toxic = 1")).collect()} == {1}
    one_id = docs.withColumn("doc_id", F.lit(1).cast("long"))
    chosen = toxicity.sample(one_id, labels, examples=20)
    assert chosen.taken == {0: 20} and chosen.labelled == {0: 60}  # rows of one id are told apart
