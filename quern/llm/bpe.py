"""Byte-level BPE with a transducer lexicon.

The corpus's frequent words are compiled, with their ids as outputs, into a
minimal acyclic automaton (words that end alike share states); its arrays lie
in one file that Spark hands to every executor and that tasks map into memory.
Words outside the lexicon are merged exactly by the vocabulary's ranks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_blocks, written

#: The byte-level splitter of the vocabulary (fixed).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the tokenizers library's splitter sees it: Unicode White_Space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The splitter for texts of code points below 0x180, whose letters, numbers and blanks the plain `re` module can name.
_SIMPLE = re.compile(r"[\x00-\u017f]*")
_BLANK = r"\t-\r \x85\xa0"
_SIMPLE_SPLIT = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+" + rf"| ?(?:_|[^\w{_BLANK}])+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
LEXICON_WORDS = 30_000
#: Words that occur less often are never in the lexicon.
LEAST_COUNT = 3
#: Unseen words whose merged ids a task keeps at hand.
MEMO_WORDS = 200_000
LONGEST = 64


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: themselves if printable, else the next code points from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in shown}
    for i, b in enumerate(b for b in range(256) if b not in set(shown)):
        table[chr(256 + i)] = b
    return table


@cache
def _alphabet() -> dict[str, int]:
    return byte_alphabet()


def _octets(shown: str) -> bytes:
    return bytes(map(_alphabet().__getitem__, shown))


class Vocabulary:
    """Ranks, ids and special tokens of a byte-level BPE file's content; each table is made when it is first asked for."""

    def __init__(self, tokenizer_json: str) -> None:
        self.content = tokenizer_json
        self.special = {t["content"]: t["id"] for t in json.loads(tokenizer_json)["added_tokens"]}
        pattern = SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
        self.split = regex.compile(pattern)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @cached_property
    def ids(self) -> dict[bytes, int]:
        return {_octets(t): i for t, i in json.loads(self.content)["model"]["vocab"].items()}

    @cached_property
    def ranks(self) -> dict[tuple[bytes, bytes], int]:
        pairs = (m if isinstance(m, list) else m.split(" ") for m in json.loads(self.content)["model"]["merges"])
        return {(_octets(a), _octets(b)): r for r, (a, b) in enumerate(pairs)}

    @cached_property
    def tokens(self) -> dict[int, bytes]:
        return {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}

    def words(self, text: str) -> list[str]:
        """Words in order; special tokens' strings stand alone."""
        if self.parts is None or not any(s in text for s in self.special):
            return (_SIMPLE_SPLIT if _SIMPLE.fullmatch(text) else self.split).findall(text)
        out: list[str] = []
        for i, part in enumerate(self.parts.split(text)):
            out += [part] if i % 2 else self.split.findall(part)
        return out

    @cached_property
    def pair_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted pairs of ids, their ranks, the ids they merge to, and the ids of the 256 bytes."""
        ids = self.ids
        rows = sorted((ids[a] << 32 | ids[b], r, ids[a + b]) for (a, b), r in self.ranks.items())
        pair, rank, merged = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        return pair, rank, merged, np.array([ids[bytes([b])] for b in range(256)], np.int64)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Packed exact ids of many words at once: in each round, every word merges all places of its pair of least rank, leftmost first."""
        out: list[bytes] = [b""] * len(words)
        few = []
        for i, w in enumerate(words):
            if len(w) > LONGEST:
                out[i] = np.array(self.merge(w), "<u4").tobytes()
            elif w:
                few.append(i)
        pair, rank, merged, octets = self.pair_table
        none = np.int64(1) << 40
        sizes = np.fromiter((len(words[i]) for i in few), np.int64, len(few))
        symbol = octets[np.frombuffer(b"".join(words[i] for i in few), np.uint8)]
        owner = np.repeat(np.array(few, np.int64), sizes)

        def ranked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rank of the pair that begins at each place, and what it merges to."""
            key = symbol[at] << 32 | symbol[at + 1]
            where = np.minimum(np.searchsorted(pair, key), len(pair) - 1)
            ok = (pair[where] == key) & (owner[at] == owner[at + 1])
            return np.where(ok, rank[where], none), merged[where]

        ranks, to = np.full(len(symbol), none), np.zeros(len(symbol), np.int64)
        if len(symbol) > 1:
            ranks[:-1], to[:-1] = ranked(np.arange(len(symbol) - 1))
        while len(symbol):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.append(starts, len(owner)))
            least = np.minimum.reduceat(ranks, starts)
            done = least == none
            if done.any():
                packed = symbol.astype("<u4").tobytes()
                for i, s, n in zip(owner[starts[done]].tolist(), starts[done].tolist(), sizes[done].tolist(), strict=True):
                    out[i] = packed[4 * s : 4 * (s + n)]
                stay = np.repeat(~done, sizes)
                symbol, owner, ranks, to = symbol[stay], owner[stay], ranks[stay], to[stay]
                least, sizes = least[~done], sizes[~done]
                if not len(symbol):
                    break
            hit = ranks == np.repeat(least, sizes)
            at = np.flatnonzero(hit)
            begins = np.concatenate(([True], at[1:] != at[:-1] + 1))  # of places side by side, every other one merges
            run = at[np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))]
            at = at[(at - run) % 2 == 0]
            symbol[at] = to[at]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            at = np.cumsum(stay)[at] - 1
            symbol, owner, ranks, to = symbol[stay], owner[stay], ranks[stay], to[stay]
            near = np.unique(np.concatenate((at, at[at > 0] - 1)))
            ranks[near[near == len(symbol) - 1]] = none
            near = near[near < len(symbol) - 1]
            ranks[near], to[near] = ranked(near)
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact ids of a word by the definition: always merge the pair of least rank, leftmost first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        if len(parts) > 48:
            return self._merge_long(parts)
        ranks = self.ranks
        while len(parts) > 1:
            found = [ranks.get(p, 1 << 30) for p in zip(parts, parts[1:], strict=False)]
            least = min(found)
            if least == 1 << 30:
                break
            a, b = parts[(at := found.index(least))], parts[at + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [self.ids[p] for p in parts]

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        """The same over a linked list and a heap: n log n for words of any length."""
        n, ranks = len(parts), self.ranks
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or parts[i] is not a and parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = a + b, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get((parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
            if before[i] >= 0 and (r := ranks.get((parts[before[i]], parts[i]))) is not None:
                heapq.heappush(heap, (r, before[i], parts[before[i]], parts[i]))
        return [self.ids[p] for i, p in enumerate(parts) if alive[i]]


class Lexicon:
    """Minimal acyclic transducer: word -> its number (sum of arc outputs) -> ids."""

    FIELDS = ("arcs", "targets", "outputs", "finals", "starts", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> Lexicon:
        """Add sorted words one by one; a state that can't change any more is replaced by its equal in the register."""
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}

        def settle(path: list[tuple[int, int]], keep: int) -> None:
            while len(path) > keep:
                parent, byte = path.pop()
                child = arcs[parent][byte]
                key = (final[child], tuple(arcs[child].items()))
                arcs[parent][byte] = register.setdefault(key, child)

        path: list[tuple[int, int]] = []
        last = b""
        for word in sorted(words):
            common = len(os.path.commonprefix([last, word]))
            settle(path, common)
            at = arcs[path[-1][0]][path[-1][1]] if path else 0
            for byte in word[common:]:
                arcs.append({})
                final.append(False)
                arcs[at][byte] = len(arcs) - 1
                path.append((at, byte))
                at = len(arcs) - 1
            final[at] = True
            last = word
        settle(path, 0)
        size: dict[int, int] = {}

        def count(state: int) -> int:  # words that end at or below a state; depth is a word's length
            if state not in size:
                size[state] = final[state] + sum(count(t) for t in arcs[state].values())
            return size[state]

        count(0)
        number = {s: i for i, s in enumerate(sorted(size, key=lambda s: (s != 0, s)))}
        rows = []
        for s in number:
            ahead = int(final[s])
            for byte in sorted(arcs[s]):
                rows.append((number[s] << 8 | byte, number[arcs[s][byte]], ahead))
                ahead += size[arcs[s][byte]]
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 3)
        lists = [words[w] for w in sorted(words)]
        finals = np.zeros(len(number), np.uint8)
        for s, i in number.items():
            finals[i] = final[s]
        return cls({
            "arcs": table[:, 0].astype(np.uint32), "targets": table[:, 1].astype(np.uint32), "outputs": table[:, 2].astype(np.uint32), "finals": finals,
            "starts": np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.uint32), "ids": np.array([i for x in lists for i in x], "<u4"),
        })

    def save(self, path: str) -> None:
        parts = [np.ascontiguousarray(getattr(self, f)) for f in self.FIELDS]
        head = json.dumps([(f, p.dtype.str, len(p)) for f, p in zip(self.FIELDS, parts, strict=True)]).encode()
        with open(path, "wb") as out:
            out.write(len(head).to_bytes(8, "little") + head + b" " * (-len(head) % 8))
            for p in parts:
                out.write(p.tobytes() + b"\0" * (-p.nbytes % 8))

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        """Arrays of a saved lexicon, mapped read-only: all tasks of a machine share the pages."""
        whole = np.memmap(path, np.uint8, "r")
        n = int.from_bytes(whole[:8].tobytes(), "little")
        at, arrays = 8 + n + (-n % 8), {}
        for name, dtype, length in json.loads(whole[8 : 8 + n].tobytes()):
            size = np.dtype(dtype).itemsize * length
            arrays[name] = whole[at : at + size].view(dtype)
            at += size + (-size % 8)
        return cls(arrays)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 if it isn't in the lexicon; all words step through the automaton together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(words) else sizes
        text = np.frombuffer(b"".join(words), np.uint8)
        state, out = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        alive = np.flatnonzero((sizes > 0) & (sizes <= LONGEST)) if len(self.arcs) else np.zeros(0, np.int64)
        state[(sizes == 0) | (sizes > LONGEST) | (len(self.arcs) == 0)] = -1
        for column in range(LONGEST):
            alive = alive[sizes[alive] > column]
            if not len(alive):
                break
            key = state[alive] << 8 | text[starts[alive] + column]
            at = np.minimum(np.searchsorted(self.arcs, key.astype(np.uint32)), len(self.arcs) - 1)
            ok = self.arcs[at] == key
            state[alive] = np.where(ok, self.targets[at].astype(np.int64), -1)
            out[alive] += np.where(ok, self.outputs[at].astype(np.int64), 0)
            alive = alive[ok]
        known = state >= 0
        known[known] = self.finals[state[known]] == 1
        return np.where(known, out, -1)

    def all_ids(self) -> list[bytes]:
        """Packed ids of every word, by number."""
        whole, starts = self.ids.tobytes(), (4 * self.starts.astype(np.int64)).tolist()
        return [whole[a:b] for a, b in zip(starts, starts[1:], strict=False)]

    def ids_of(self, number: int) -> bytes:
        return self.ids[self.starts[number] : self.starts[number + 1]].tobytes()


def frequent_words(docs: DataFrame, tokenizer_json: str, text: str = "text", most: int = LEXICON_WORDS) -> list[bytes]:
    """The commonest words of at most LONGEST bytes, `most` at most (words of nearly one count are taken together); counts cover every whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, seen = Vocabulary(tokenizer_json), Counter()

        def flush() -> pa.RecordBatch:
            pairs = [(k, n) for w, n in seen.items() if len(k := w.encode()) <= LONGEST]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.int64())], names=["word", "n"])

        for b in text_blocks(batches, "text"):
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(vocab.words(t))
            if len(seen) > 250_000:
                yield flush()
        yield flush()

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    common = written(counted.where(F.col("n") >= LEAST_COUNT), "frequent-words")
    # the step of counts from which at most `most` words are left: a short table of steps reaches the driver, then the words
    step = F.floor(F.log2(F.col("n")) * 16).cast("int")
    left, least = most, None
    for r in common.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        if r["words"] > left:
            break
        left, least = left - r["words"], r["step"]
    if least is None:
        return []
    return sorted(bytes(r["word"]) for r in common.where(step >= least).select("word").collect())


def compile_lexicon(spark: SparkSession, words: list[bytes], tokenizer_json: str) -> str:
    """Build the transducer, give its file to all executors; returns the file's name."""
    vocab = Vocabulary(tokenizer_json)
    special = {s.encode() for s in vocab.special}
    lexicon = Lexicon.build({w: vocab.merge(w) for w in words if w and w not in special})
    folder = tempfile.mkdtemp(prefix="quern-lexicon-")
    path = f"{folder}/lexicon"
    lexicon.save(path)
    with open(path, "rb") as f:
        name = f"lexicon-{hashlib.sha256(f.read()).hexdigest()[:16]}-{uuid.uuid4().hex[:8]}.bin"  # a session takes a name once
    os.rename(path, f"{folder}/{name}")
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def encode(docs: DataFrame, tokenizer_json: str, lexicon: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids): ids of every whole text as binary, little-endian unsigned 32-bit.

    Null and empty texts have no ids; strings of special tokens in a text get
    the special id, as the tokenizers library does. Repeated rows repeat; an
    empty table gives an empty result; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, lex = Vocabulary(tokenizer_json), Lexicon.mapped(SparkFiles.get(lexicon))
        memo = {s: np.array([i], "<u4").tobytes() for s, i in vocab.special.items()}
        compiled = lex.all_ids()
        for b in text_blocks(batches, "text", 2 << 20):
            split = [vocab.words(t) if t else [] for t in b.column(1).to_pylist()]
            distinct = list(set().union(*split))
            raw = [w.encode() for w in distinct]
            packed: dict[str, bytes] = {}
            unseen: list[int] = []
            for i, (word, number) in enumerate(zip(distinct, lex.numbers(raw).tolist(), strict=True)):
                if number >= 0:
                    packed[word] = compiled[number]
                elif (ids := memo.get(word)) is not None:
                    packed[word] = ids
                else:
                    unseen.append(i)
            for i, ids in zip(unseen, vocab.merge_all([raw[i] for i in unseen]), strict=True):
                packed[distinct[i]] = ids
                if len(memo) < MEMO_WORDS:
                    memo[distinct[i]] = ids
            get = packed.__getitem__
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b"".join(map(get, ws)) for ws in split], pa.binary())], names=[id_col, "ids"])

    return docs.select(F.col(id_col), F.col(text).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids binary")


def decode(encoded: DataFrame, tokenizer_json: str) -> DataFrame:
    """Add decoded, the text of ids (special tokens included; bytes that are no UTF-8 become U+FFFD). Null ids: null. A column of that name is replaced."""
    encoded = encoded.drop("decoded")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Vocabulary(tokenizer_json).tokens
        table = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        get = table.__getitem__
        for b in text_blocks(batches, "ids", 2 << 20):
            ids = b.column(b.schema.get_field_index("ids")).to_pylist()
            texts = [None if x is None else b"".join(map(get, memoryview(x).cast("I"))).decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, fields + ", decoded string")


def round_trip_digest(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """The contract's columns for documents."""
    words = frequent_words(docs, tokenizer_json)
    name = compile_lexicon(docs.sparkSession, words, tokenizer_json)
    back = decode(encode(docs, tokenizer_json, name), tokenizer_json)
    return back.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
