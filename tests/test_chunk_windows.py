"""Windows of tokens against brute force; a window's row holds no more than its own text and parts."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from quern.operators import chunking
from quern.sources import parsers

BLANK = np.array([chr(c).isspace() for c in range(0x3002)])


def test_token_bounds_are_those_of_the_pattern():
    dealt = random.Random(1)
    for _ in range(200):
        text = "".join(dealt.choice(" \t\n\x1c\x85\u3000\u2003aé한😀_.") for _ in range(dealt.randrange(40)))
        begin, end = chunking.token_bounds(text, BLANK)
        assert list(zip(begin.tolist(), end.tolist(), strict=True)) == [m.span() for m in re.finditer(r"[^\s\x1c-\x1f\x85]+", text)]


def test_windows_of_sections_with_several_parts(spark):
    paragraphs = [" ".join(f"p{i}é{j}" for j in range(n)) for i, n in enumerate((3, 1, 12, 40, 2))]
    found = parsers.plain_elements(spark.createDataFrame([("d", "\n\n".join(paragraphs)), ("none", " \n\n ")], "source_id string, text string"))
    got = chunking.heading_aware(found, 10, 4).orderBy("chunk_ord").collect()
    whole, names = "\n\n".join(paragraphs), [r["element_id"] for r in found.orderBy("ord").collect()]
    spans = [m.span() for m in re.finditer(r"\S+", whole)]
    starts = [sum(len(p) + 2 for p in paragraphs[:i]) for i in range(5)]
    want = []
    for at in range(0, 58 - 10 + 6, 6):
        s, e = spans[at][0], spans[min(at + 10, 58) - 1][1]
        want.append((s, e, whole[s:e], min(10, 58 - at), [n for n, b, p in zip(names, starts, paragraphs, strict=True) if b < e and s < b + len(p)]))
    assert [(r["char_start"], r["char_end"], r["text"], r["token_count"], r["element_ids"]) for r in got] == want


def test_a_window_does_not_carry_its_section(spark):
    """A text of 150,000 tokens has 1,072 windows: a copy of it for each would be 600 MB."""
    rows = chunking.token_windows(chunking.sections(parsers.plain_elements(spark.createDataFrame([("d", "abc " * 150_000)], "source_id string, text string"))), 180, 140)
    assert {"window", "char_start", "char_end", "token_count", "text", "hit"} < set(rows.columns) and not {"parts", "tok", "section"} & set(rows.columns)
    size = F.sum(F.length("text") + 50 * F.size("hit")).alias("n")
    assert rows.agg(F.count("*").alias("windows"), size).first().asDict() == {"windows": 1072, "n": 1071 * (719 + 50) + (150_000 - 1071 * 140) * 4 - 1 + 50}


def test_clusters_are_the_nearest_running_means():
    texts = ["a b c", "a b d", "x y z", "x y w", "a b c d", "", "q", "x y z w"]
    vectors = [chunking.hashed(t) for t in texts]
    means: list[tuple[dict, int]] = []
    want = []
    for v in vectors:
        sims = [round(chunking._cos(v, m), 12) for m, _ in means]
        best = max(range(len(sims)), key=sims.__getitem__, default=-1)
        if best < 0 or sims[best] <= 0.5:
            best = len(means)
            means.append((dict(v), 1))
        else:
            mean, n = means[best]
            means[best] = ({k: mean.get(k, 0.0) + (v.get(k, 0.0) - mean.get(k, 0.0)) / (n + 1) for k in mean.keys() | v.keys()}, n + 1)
        want.append(best)
    assert chunking.clusters(vectors, 0.5) == want
    assert chunking._hashed_token.cache_info().maxsize is not None
