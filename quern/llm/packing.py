"""Packing: best-fit decreasing with a segment tree over remaining capacities.

Documents are tokenised, cut into full windows and one rest; rests are dealt
into packing groups and each group is packed longest first, every rest into
the tightest open window.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import text_blocks, written

#: Pieces of one packing group: bounds the task, and is long enough for a padding of a few windows.
GROUP_PIECES = 20_000


class CapacityTree:
    """Segment tree over remaining capacities 0..most; finds the least capacity >= need with an open window."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, at: int, by: int) -> None:
        i, count = at + self.leaves, self.count
        while i:
            count[i] += by
            i >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest open window that holds need, removed; None if there is none."""
        i, count = need + self.leaves, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up to the first ancestor with something on its right
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each length (1..capacity); equal lengths keep their order."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, made = CapacityTree(capacity), 0
    for i in np.argsort(-np.asarray(lengths, np.int64), kind="stable"):
        need = int(lengths[i])
        got = tree.take(need)
        if got is None:
            left, w = capacity, made
            made += 1
        else:
            left, w = got
        window[i], offset[i] = w, capacity - left
        if left > need:
            tree.put(left - need, w)
    return window, offset


#: Code points below 0x180, where normal form and lower case are one character each but for U+0130.
_SIMPLE = re.compile(r"[\x00-\u012f\u0131-\u017f]*")
#: The vocabulary's splitter (fixed), written out for those code points.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|(?:_|[^\w\t-\r \x85\xa0])+")
_SHARED: dict[str, WordTokenizer] = {}


class _Ids(dict):
    """Packed ids of parts; a part is merged by the library's model when first asked for, and kept up to `most` parts."""

    def __init__(self, model: object, most: int) -> None:
        super().__init__()
        self.model, self.most = model, most
        self.shown = {b: c for c, b in byte_alphabet().items()}

    def __missing__(self, part: str) -> bytes:
        plain = "".join(map(self.shown.__getitem__, part.encode()))
        packed = array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()
        if len(self) < self.most:
            self[part] = packed
        return packed


class WordTokenizer:
    """The tokenizers library's ids of whole texts, for a lower-casing vocabulary with word ends.

    Texts of simple code points are split here and only their different parts
    go to the library's model. In other texts this holds for each run between
    blanks, which normaliser and splitter never join; the rest of the runs go
    through the whole library.
    """

    def __init__(self, tokenizer_json: str, most: int = 300_000) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t["content"] for t in json.loads(tokenizer_json)["added_tokens"]]
        self.ids = _Ids(self.tok.model, most)

    @classmethod
    def shared(cls, tokenizer_json: str) -> WordTokenizer:
        """One for each worker process: its parts serve all tasks that run there."""
        key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
        if key not in _SHARED:
            _SHARED[key] = cls(tokenizer_json)
        return _SHARED[key]

    def _own(self, text: str) -> bytes | None:
        if not _SIMPLE.fullmatch(text) or any(s in text for s in self.special):
            return None
        return b"".join(map(self.ids.__getitem__, _PARTS.findall(text.lower())))

    def encode(self, text: str | None, end_id: int) -> bytes:
        """Little-endian unsigned 32-bit ids of the text (null: empty) and then end_id."""
        end = end_id.to_bytes(4, "little")
        if not text:
            return end
        packed = self._own(text)
        if packed is None:
            runs = [(self._own(run), run) for run in text.split(" ")]
            packed = b"".join(array("I", self.tok.encode(run, add_special_tokens=False).ids).tobytes() if p is None else p for p, run in runs)
        return packed + end


def pieces(docs: DataFrame, tokenizer_json: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Tokenise and cut: (id_col, start, length, ids, ids_crc32, doc_tokens), each id in exactly one row.

    ids is binary, little-endian unsigned 32-bit; with keep_ids=False it is
    left out. A null or empty text has its end id alone. Equal rows give
    equal pieces; other columns of docs are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = WordTokenizer.shared(tokenizer_json)
        for block in text_blocks(batches, "text"):
            keys = block.column(0)
            rows, out = [], {"start": [], "length": [], "ids": [], "ids_crc32": [], "doc_tokens": []}
            for row, text in enumerate(block.column(1).to_pylist()):
                ids = tok.encode(text, end_id)
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    rows.append(row)
                    out["start"].append(at // 4)
                    out["length"].append(len(piece) // 4)
                    out["ids"].append(piece)
                    out["ids_crc32"].append(zlib.crc32(piece))
                    out["doc_tokens"].append(len(ids) // 4)
            cols = {id_col: keys.take(pa.array(rows, pa.int64()))}
            cols |= {k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items() if keep_ids or k != "ids"}
            yield pa.RecordBatch.from_pydict(cols)

    schema = f"`{id_col}` {kind}, start long, length long, " + "ids binary, " * keep_ids + "ids_crc32 long, doc_tokens long"
    return docs.select(F.col(id_col), F.col(text).alias("text")).mapInArrow(cut, schema)


def pack(cut: DataFrame, capacity: int = 4096, id_col: str = "doc_id", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset to pieces; offsets of a sequence are gapless from 0.

    Full windows are sequences of their own. Rests are dealt by a hash of
    their row number into groups of about group_pieces and packed best
    fit, longest first. Rows of any kind may repeat: each is packed. Columns
    of cut that have a name of these two are replaced. An empty table gives an
    empty result.
    """
    cut = cut.drop("sequence_id", "offset")
    held = written(cut.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    n = held.where(F.col("length") < capacity).count()
    groups = max(1, -(-n // group_pieces))
    dealt = held.withColumn("__group", F.when(F.col("length") < capacity, F.pmod(F.xxhash64("__row"), F.lit(groups))).otherwise(F.lit(-1)).cast("long"))
    rests = dealt.where("__group >= 0")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rests.schema)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", id_col, "start"], ascending=[False, True, True], kind="stable", ignore_index=True)
        window, offset = best_fit_decreasing(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=window + pdf["__group"] * (1 << 32), offset=offset)

    packed = rests.groupBy("__group").applyInPandas(fill, fields + ", sequence_id long, offset long")
    # full windows: numbered by task and row, from where no packed window's number reaches
    whole = dealt.where("__group < 0").withColumns({"sequence_id": F.lit(1 << 62).cast("long") + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(whole).drop("__group", "__row")


def pack_digest(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """The contract's columns for documents."""
    return pack(pieces(docs, tokenizer_json, keep_ids=False)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
