"""Small tables with nulls, empties, ties, repeats and clashing names, held against plain definitions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import bpe, components, embedding, langid, packing, quality, sharding, simhash, substrings, suffix, urls
from quern.llm.queries import QUERIES, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
random.seed(5)
SYLLABLES = ["ka", "lo", "mi", "ren", "tas", "vu", "ze", "pol", "ist", "qua", "dor", "eth"]


def prose(n: int) -> str:
    return " ".join("".join(random.choice(SYLLABLES) for _ in range(random.randint(1, 4))) for _ in range(n))


PASSAGE = prose(70)
TEXTS = [
    None, "", "   \n\t ", "one", "Two Words", "12 34 !!", prose(300), PASSAGE, prose(60) + " " + PASSAGE, PASSAGE + "\n" + prose(90), prose(40) + "  " + PASSAGE + " " + prose(15), "ab " * 400,
    "x" * 3000, "line\nline\nline\nother words follow here now\n", "é ü 한국어 <|endoftext|> it's  \x1c ok\u00a0", prose(500), *(prose(random.randint(1, 120)) for _ in range(40)),
]
TEXTS += [TEXTS[6], TEXTS[6], TEXTS[15].replace("ka", "KA", 1), TEXTS[15] + " more"]


def documents(spark, texts=TEXTS, ids=None):
    ids = ids or list(range(len(texts)))
    langs = ["en" if i % 3 else "fr" for i in range(len(texts))]
    rows = [(i, t, None if n % 17 == 3 else g, None if n % 11 == 5 else f"s{n % 3}", 0, "kept") for n, (i, t, g) in enumerate(zip(ids, texts, langs, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string").repartition(3)


def empty(spark):
    return documents(spark).where("false")


def words(t):
    return WORD.findall(t or "")


@pytest.mark.parametrize("few", [100_000, 0])
def test_components(spark, few, monkeypatch):
    monkeypatch.setattr(components, "PARTITION_EDGES", few)
    edges = spark.createDataFrame([(9, 8), (8, 7), (7, 7), (1, 5), (5, 1), (4, 5), (20, 21)], "a long, b long")
    assert {r["node"]: r["component"] for r in components.components(edges).collect()} == {7: 7, 8: 7, 9: 7, 1: 1, 4: 1, 5: 1, 20: 20, 21: 20}
    assert components.components(edges.where("false")).count() == 0


def test_language_id(spark):
    fr = [f"le chat {w} les maisons et la été où" for w in prose(60).split()]
    en = [f"the cat {w} with houses and this was" for w in prose(60).split()]
    df = documents(spark, [x for p in zip(fr, en, en, strict=True) for x in p] + [None, "123 !", "the"])
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    n = len(got)
    assert got[n - 3]["lang_pred"] == got[n - 2]["lang_pred"] == "und" and got[n - 2]["score"] == 0.0
    truth = {r["doc_id"]: r["lang"] for r in df.collect() if r["lang"]}
    own = [r for k, r in got.items() if k < n - 3 and k in truth]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in own]) > 0.95 and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    nothing = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"} and langid.identify(empty(spark)).count() == 0


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    content = vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_str(content)
    got = {r["doc_id"]: r for r in bpe.round_trip_digest(documents(spark), content).collect()}
    for i, t in enumerate(TEXTS):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert bpe.round_trip_digest(empty(spark), content).count() == 0


def test_lexicon_shares_suffixes(tmp_path):
    lists = {w.encode(): [i, i + 1] for i, w in enumerate(["walking", "talking", "talk", "walk", "stalking"])}
    lex = bpe.Lexicon.build(lists)
    assert len(lex.finals) < sum(map(len, lists)) / 2
    lex.save(str(tmp_path / "l"))
    back = bpe.Lexicon.mapped(str(tmp_path / "l"))
    asked = [*lists, b"wal", b"", b"talkings", b"x" * 99]
    assert [np.frombuffer(back.ids_of(n), "<u4").tolist() if n >= 0 else None for n in back.numbers(asked).tolist()] == [*lists.values(), None, None, None, None]
    assert bpe.Lexicon.build({}).numbers([b"a"]).tolist() == [-1]


def simhash_of(t):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(t)]
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    got = {r["doc_id"]: r for r in simhash.digest(documents(spark)).collect()}
    fps = [simhash_of(t) for t in TEXTS]
    assert [int(got[i]["fingerprint"], 16) for i in range(len(TEXTS))] == fps
    group = list(range(len(fps)))
    for _ in fps:
        group = [min(group[j] for j in range(len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= 3) for i in range(len(fps))]
    assert [got[i]["component_id"] for i in range(len(fps))] == group
    assert simhash.digest(empty(spark)).count() == 0


def test_golay_keys_meet_within_three_bits():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    of = lambda x: [set(k) for k in (lambda r, k: [k[r == i].tolist() for i in range(len(x))])(*simhash.keys(x))]
    assert all(p & q for p, q in zip(of(a), of(b), strict=True))
    assert len(set(simhash.decode(np.arange(1 << 14, dtype=np.uint32)).tolist())) <= 4096


def test_similar_documents_keep_one(spark):
    base = [prose(200) for _ in range(12)]
    near = [" ".join(w if i != 50 else "changed" for i, w in enumerate(t.split())) for t in base]
    df = documents(spark, base + near + base[:2])
    left = sorted(r["doc_id"] for r in simhash.keep_one(df).collect())
    assert left == list(range(12)) and simhash.keep_one(df).columns == df.columns


@pytest.mark.parametrize(("few", "block"), [(1000, 512), (0, 512), (0, 9)])
def test_similar_documents_of_a_crowded_key(spark, monkeypatch, few, block):
    monkeypatch.setattr(simhash, "PAIR_TEXTS", few)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "prefix_table", lambda named, nodes, similarity, counts: nodes.select("at", "n", F.lit(0).alias("key")))
    base = [prose(120) for _ in range(40)]
    df = documents(spark, [*base, *(t + " x" for t in base)])
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == list(range(40))


def edited(words, n, rng):
    """words with n of them changed, at scattered places."""
    at = set(rng.sample(range(len(words)), n))
    return [f"new{rng.random()}" if i in at else w for i, w in enumerate(words)]


def against_jaccard(spark, texts):
    """Groups of similar_documents() equal the components of exact Jaccard similarity, of all pairs, from 0.8."""
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
                lo, hi = sorted((group[i], group[j]))
                group = [lo if g == hi else g for g in group]
    got = {r["doc"]: r["component"] for r in simhash.similar_documents(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == group


def test_similar_documents_are_judged_exactly(spark):
    rng = random.Random(3)
    texts = []
    for n in (3, 4, 5, 6, 7, 8) * 4:  # similarity from 0.86 to 0.66
        base = [prose(1) + str(i) for i in range(200)]
        texts += [" ".join(base), " ".join(edited(base, n, rng))]
    line = prose(30)  # a line repeated often outweighs the rest only if repeats count
    texts += ["\n".join([line] * 40 + [prose(40)]) for _ in range(2)]
    against_jaccard(spark, texts)


def test_similar_documents_with_an_added_block(spark):
    rng = random.Random(8)
    texts = []
    for i in range(60):  # similarity from 0.79 to 0.9, by a block in front, behind or left out
        base = [prose(1) + str(i) for i in range(rng.randint(30, 300))]
        block = [prose(1) + "b" for _ in range(int(len(base) * rng.uniform(0.1, 0.25)))]
        texts += [" ".join(base), " ".join([block + base, base + block, base[len(block) * 4 // 5 :]][i % 3])]
    passage = prose(60)
    texts += [prose(20) + " " + passage + " " + prose(20) for _ in range(30)]  # a quoted passage makes no copies
    against_jaccard(spark, texts)


@pytest.mark.parametrize("most", [8192, 1])
def test_suffix_dedup(spark, most, monkeypatch):
    monkeypatch.setattr(suffix, "repeated_spans", lambda *a, **k: suffix_spans(*a, most_strings=most, **k))
    got = {r["doc_id"]: r for r in suffix.digest(documents(spark)).collect()}
    raw = [(t or "").encode() for t in TEXTS]
    seen = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    for k, t in enumerate(raw):
        cover = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                cover[i : i + 200] = True
        kept = bytes(b for b, c in zip(t, cover, strict=False) if not c)
        spans = int((cover[1:] & ~cover[:-1]).sum() + cover[0])
        assert (got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"], got[k]["kept_sha256"]) == (len(t), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest())
    assert suffix.digest(empty(spark)).count() == 0


suffix_spans = suffix.repeated_spans


def test_column_wise_construction_finds_equal_windows():
    rng = random.Random(3)
    for length in (6, 8, 200):
        stock = ["".join(rng.choice("ab" if length < 8 else "abcdef") for _ in range(3 * length)) for _ in range(3)]
        packed = [s[(a := rng.randrange(length)) : a + length + rng.randrange(1, length)].encode() for s in rng.choices(stock, k=25)]
        n = np.array([len(p) - length + 1 for p in packed])
        seen = Counter(p[i : i + length] for p, k in zip(packed, n, strict=True) for i in range(k))
        for p, k, runs in zip(packed, n, suffix.suffix_windows(length)(packed, n, np.ones(25, int), n), strict=True):
            hit = np.zeros(k, bool)
            for o, m, _ in runs:
                hit[o : o + m] = True
            assert hit.tolist() == [seen[p[i : i + length]] > 1 for i in range(k)]


@pytest.mark.parametrize("most", [8192, 1])
def test_substring_dedup(spark, most, monkeypatch):
    plain = substrings.repeated_spans
    monkeypatch.setattr(substrings, "repeated_spans", lambda *a, **k: plain(*a, most_strings=most, **k))
    got = {r["doc_id"]: r for r in substrings.digest(documents(spark)).collect()}
    seen: set = set()
    for k, t in enumerate(TEXTS):
        w = words(t)
        own = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        gone = {j for i, x in enumerate(own) if x in seen for j in range(i, i + 50)}
        seen |= set(own)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (got[k]["n_words"], got[k]["n_removed"], got[k]["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    same_id = substrings.dedup(documents(spark, [PASSAGE, PASSAGE, PASSAGE], [4, 4, None])).collect()
    assert sorted(r["n_removed"] for r in same_id) == [0, 0, 70] and same_id[0]["spans"] == "kept"


def test_embedding_dedup(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 32))
    x[100:180] = x[7] + 0.05 * rng.standard_normal((80, 32))
    x[200], x[300] = x[201] * 3, x[301] + 1e-9
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows[5], rows[6], rows[9], rows[10] = (5, None), (6, [0.0] * 32), (9, [float("nan")] + [1.0] * 31), (10, [None] + [1.0] * 31)
    rows += [(201, rows[201][1]), (None, [1e300] * 32)]
    got = embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit("x"))).collect()
    assert len(got) == len(rows)
    ok = [r for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) and r[0] is not None]
    m = np.array([r[1] for r in ok])
    m /= np.linalg.norm(m, axis=1)[:, None]
    links = m @ m.T >= 0.9
    n = {}
    for r, k in zip(ok, links.sum(axis=1) - 1, strict=True):
        n.setdefault(r[0], k)
    by = {r["vec_id"]: r for r in got}
    assert all(by[i]["n_links"] == k for i, k in n.items()) and by[5]["n_links"] == by[6]["n_links"] == by[9]["n_links"] == 0
    assert by[179]["component_id"] == 7 and not by[179]["kept"] and by[7]["kept"] and by[5]["kept"]
    assert embedding.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def against_all_pairs(spark, x, **how):
    """near_duplicates() of the rows of x equals links and components of a comparison of all pairs."""
    got = {r["vec_id"]: r for r in embedding.near_duplicates(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), **how).collect()}
    m = x / np.linalg.norm(x, axis=1)[:, None]
    links = m @ m.T >= 0.9
    least = np.arange(len(x))
    for _ in range(len(x)):
        least = np.where(links, least[None, :], len(x)).min(axis=1)
    assert [got[i]["n_links"] for i in range(len(x))] == (links.sum(axis=1) - 1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == least.tolist()


def test_embedding_dedup_links_tight_groups(spark):
    rng = np.random.default_rng(2)
    a, b, c = np.linalg.qr(rng.standard_normal((32, 3)))[0].T
    turn = lambda u, v, cos: cos * u + np.sqrt(1 - cos * cos) * v
    x = np.concatenate((np.tile(a, (20, 1)), np.tile(turn(a, b, 0.93), (20, 1)), turn(a, c, 0.92) + 1e-4 * rng.standard_normal((12, 32)), rng.standard_normal((150, 32))))
    against_all_pairs(spark, x)


def test_embedding_dedup_does_not_depend_on_the_lists(spark, monkeypatch):
    monkeypatch.setattr(embedding, "MOST_ROUNDS", 1)
    monkeypatch.setattr(embedding, "TREES", 1)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((120, 24))
    for i in range(120):  # chains of 12, each vector at about 0.93 from the last
        if i % 12:
            x[i] = x[i - 1] + 0.4 * np.linalg.norm(x[i - 1]) / np.sqrt(24) * rng.standard_normal(24)
    against_all_pairs(spark, x, k=1)


def test_packing(spark):
    from tokenizers import Tokenizer

    content = vocabulary("word_bpe_49k.json")
    texts = [*TEXTS, " ".join(prose(400) for _ in range(12))]
    rows = packing.pack_digest(documents(spark, texts), content).collect()
    tok = Tokenizer.from_str(content)
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for _, group in groupby(rows, lambda r: r["sequence_id"]):
        at = 0
        for r in sorted(group, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert packing.pack_digest(empty(spark), content).count() == 0


def groupby(rows, key):
    out: dict = {}
    for r in rows:
        out.setdefault(key(r), []).append(r)
    return out.items()


def test_best_fit_decreasing_takes_the_tightest_window():
    lengths = np.array([60, 50, 40, 35, 10, 5])
    window, offset = packing.best_fit_decreasing(lengths, 100)
    assert window.tolist() == [0, 1, 0, 1, 1, 1] and offset.tolist() == [0, 0, 60, 50, 85, 95]
    rng = random.Random(1)
    many = np.array([rng.randint(1, 4096) for _ in range(3000)])
    window, _ = packing.best_fit_decreasing(many, 4096)
    assert (window.max() + 1) * 4096 < many.sum() * 1.02


def judged(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_url_filters(spark):
    urls_ = [None, "", "no scheme", "http://", "HTTP://WWW.Example.com/en/7x?q#f", "https://com/en/", "x://example.com/en/6", "a://b.example.net/de/81", "a://example.net/de/9", "a://notexample.net/de/8", "a://x.org/es", "a://x.org/es/", "a://u@x.com:80/en/", "a://x.com?/en/", "a://com./en/", "a://.com/en/a", "a://b://c.com/en/"]
    rules = [*urls.RULES, ("allow", "b.example.net", "/"), ("block", "example.net", "/de/81")]
    for r in (urls.RULES, rules, []):
        got = {x["page_id"]: tuple(x)[1:] for x in urls.match_rules(spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string"), r).collect()}
        assert got == {i: judged(u, r) for i, u in enumerate(urls_)}
    assert urls.match_rules(spark.createDataFrame([], "page_id long, url string"), urls.RULES).count() == 0


def test_url_filters_query_has_the_verdicts_of_the_contract(spark, tmp_path):
    want = {
        0: ("com", "/en/", "com/en/", "block"), 1: ("a.com", "/en/7", "com/en/", "block"), 2: ("www.example.com", "/en/71", "example.com/en/7", "allow"),
        3: ("net", "/de/", "net/de/", "allow"), 4: ("example.net", "/de/9", "net/de/", "allow"), 5: ("a.net", "/de/8", "net/de/", "allow"),
        6: ("b.example.net", "/de/8", "example.net/de/8", "block"), 7: ("x.org", "/es/1", "org/es/", "block"), 8: ("x.org", "/de/", None, "allow"),
    }
    rows = [(i, f"http://{host}{path}") for i, (host, path, _, _) in want.items()]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r["page_id"]: tuple(r)[1:] for r in QUERIES["op7_url_filters"](spark, str(tmp_path)).collect()} == want


def test_url_filters_with_many_rules(spark):
    rng = random.Random(6)
    labels, letters = ["com", "net", "a", "b", "c", "x1"], "ab/"
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda n: "/" + "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    rules = sorted({(rng.choice(["allow", "block"]), host(), path(6)) for _ in range(20_000)})
    pages = [(i % 300, f"http://{host()}{path(12)}") for i in range(1500)] + [(None, "http://com/")] * 40
    got = urls.match_rules(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "verdict string, host string, path string"), ranges=7).collect()
    by_host: dict = {}
    for v, h, p in rules:
        by_host.setdefault(h, []).append((v, h, p))
    near = lambda u: [r for k in range(u.split("/")[2].count(".") + 1) for r in by_host.get(".".join(u.split("/")[2].split(".")[k:]), [])]
    want = Counter((i, *judged(u, near(u))) for i, u in pages)
    assert Counter(map(tuple, got)) == want


def test_quality_rules(spark):
    clean = [prose(80) for _ in range(300)]
    junk = [" ".join(w + "###" for w in prose(80).split()) for _ in range(6)]
    texts = TEXTS + clean + junk
    got = {r["doc_id"]: r for r in quality.judge(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        lines = [x for x in (t or "").split("\n") if words(x)]
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        want = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert tuple(got[i][c] for c in quality.COUNTS) == want
        assert got[i]["base_failed"] == (len(w) < 10 or 100 * len(hit) > 20 * len(w)) and not (got[i]["kept"] and got[i]["base_failed"])
    at = len(TEXTS)
    assert all(got[i]["kept"] for i in range(at, at + 300)) and not any(got[i]["kept"] for i in range(at + 300, at + 306))
    assert quality.judge(empty(spark)).count() == 0


def test_quality_thresholds_differ_by_source(spark):
    plain = [(i, prose(60) + " # # #", "en", "plain") for i in range(30)]
    marked = [(100 + i, " ".join(w + "#" if k % 3 else w for k, w in enumerate(prose(60).split())), "en", "marked") for i in range(30)]
    same = marked[0][1]
    rows = [*plain, *marked, (1000, same, "en", "plain"), (1001, same, "en", "marked")]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[1000] and got[1001] and all(got[r[0]] for r in plain + marked)


def test_sketches_merge(spark):
    rows = spark.range(1000).select(F.lit("a").alias("g_lang"), F.when(F.col("id") < 700, "x").otherwise("y").alias("g_source"), F.lit("f").alias("feature"), quality.bucket(F.col("id").cast("double")).alias("bucket"))
    s = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    q = quality.quantiles(quality.merge(s, ["g_lang"]), ["g_lang"], {"m": 0.5}).first()
    assert q["total"] == 1000 and abs(q["m"] - 500) <= 11


def test_sharding(spark):
    texts = TEXTS * 6 + ["same text here"] * 150
    got = sharding.shard_digest(documents(spark, texts), 7).collect()
    assert len(got) == len(texts)
    size = {i: len((t or "").encode()) + 16 for i, t in enumerate(texts)}
    assert all(r["size"] == size[r["doc_id"]] and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) and r["law"] == "bytes" and r["grown_shard"] is None for r in got)
    loads, share = Counter(), sum(size.values()) / 7
    for s, rows in groupby(got, lambda r: r["shard"]):
        assert sorted(r["slot"] for r in rows) == list(range(len(rows))) and 0 <= s < 7
        loads[s] = sum(r["size"] for r in rows)
    assert max(abs(v - share) for v in loads.values()) <= 2 * max(size.values())
    assert sharding.shard_digest(empty(spark)).count() == 0


def test_columns_with_clashing_names(spark):
    df = documents(spark, TEXTS[:12]).withColumns({c: F.lit("old") for c in ("kept", "n_words", "kept_text", "n_removed", "k1", "shard", "slot", "size", "n_bytes", "n_spans")})
    by = substrings.dedup(df)
    assert len(by.columns) == len(set(by.columns)) and {r["n_words"] for r in by.collect()} >= {0, 300} and by.first()["kept"] == "old"
    out = suffix.dedup(df)
    assert len(out.columns) == len(set(out.columns)) and max(r["n_bytes"] for r in out.collect()) == max(len((t or "").encode()) for t in TEXTS[:12])
    sharded = sharding.shard(df, 3)
    assert len(sharded.columns) == len(set(sharded.columns)) and {r["shard"] for r in sharded.collect()} <= {0, 1, 2}
    for call in (lambda: substrings.dedup(df, text="kept_text"), lambda: suffix.dedup(df, text="kept"), lambda: sharding.shard(df, 3, text="k1")):
        with pytest.raises(ValueError):
            call()


def test_null_and_repeated_ids(spark):
    texts = [prose(12) for _ in range(300)]
    df = documents(spark, texts, [None] * 150 + [7] * 150)
    rows = sharding.shard_digest(df, 4).collect()
    assert len(rows) == 300 and all(sorted(r["slot"] for r in g) == list(range(len(g))) for _, g in groupby(rows, lambda r: r["shard"]))
    held = packing.pack(packing.pieces(df, vocabulary("word_bpe_49k.json")), group_pieces=40).collect()
    assert len(held) == 300 and len({r["sequence_id"] >> 32 for r in held}) >= 6  # rests of one id are dealt over groups
    for _, g in groupby(held, lambda r: r["sequence_id"]):
        at = 0
        for r in sorted(g, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    said = langid.identify(df).collect()
    assert len(said) == 300 and not any(r["held_out"] for r in said if r["doc_id"] is None)


def test_language_id_of_many_dirty_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    rows = [(i, (f"été où {w} là" if i % 2 else f"the {w} with that"), "fr" if i % 2 else "en") for i, w in enumerate(prose(80).split())]
    rows += [(1000 + i, prose(4), f"odd{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, per_language=25)
    assert model.langs == ["en", "fr"]
    got = langid.predict(df, model).where("doc_id < 1000").collect()
    assert np.mean([r["lang_pred"] == ("fr" if r["doc_id"] % 2 else "en") for r in got]) > 0.95


def test_merges_of_many_words_at_once():
    vocab = bpe.Vocabulary(vocabulary("byte_bpe_50k.json"))
    rng = random.Random(9)
    words_ = [w.encode() for w in (prose(300) + " " + " ".join(TEXTS[14].split())).split()] + [b"", b"a", b"aaaaaaaaa", b" aaa aaaa", b"x" * 200, bytes(range(256)), b"\xff\xfe" * 20]
    words_ += [bytes(rng.choice(b"abe \n\xc3\xa9") for _ in range(rng.randint(1, 70))) for _ in range(500)]
    assert [np.frombuffer(p, "<u4").tolist() for p in vocab.merge_all(words_)] == [vocab.merge(w) for w in words_]
    assert vocab.merge_all([]) == []


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    good = [prose(150) for _ in range(30)]
    docs = documents(spark, [*good, good[0], good[1] + " x", " ".join(w + "%%%" for w in prose(60).split()), None, "a b", prose(60) + " " + " ".join(good[2].split()[:80])])
    found = docs.select(c.COLUMNS)
    sizes = {}
    for name, stage in c.STAGES:
        found = stage(spark, found, "")
        sizes[name] = found.count()
        if name != "packing":
            assert found.columns == c.COLUMNS
    assert sizes == {"quality": 33, "language": 33, "near_dedup": 31, "substring_dedup": 31, "packing": 31}


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
