"""Encoding texts with a public byte-level BPE by monoid tree reduction.

A piece of text is a monoid element: its ids and the windows at its two ends. A window reaches to the first (last) *certain*
boundary: a place between two characters at which the pre-tokeniser splits whatever stands further left or right (a run of
letters, digits or punctuation ends there). Merges never cross such a place, so two neighbours are joined by re-encoding the
two windows at their seam, and the ids outside are proved unchanged. A piece without such a place is one window, which
grows with every join until it has one.

Every text is halved recursively down to LEAF characters and joined up the tree. Of a text above SEGMENT characters the
segments are rows, and a level of the tree is one grouping of neighbours two by two, so that no task holds a text and its ids but for
the last, whose row is the result. Decoding concatenates up the same tree.
"""

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolmill.sources.tables import cut

TOKENIZERS = "/opt/tokenizers"
#: Characters of a leaf of the tree, and of the segments that are rows of their own.
LEAF, SEGMENT = 768, 1 << 14
#: Fixed value: the pre-tokeniser's public pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CERTAIN = r"(?<=\S)(?= \S)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])"
CERTAIN, CERTAIN_BACKWARDS = regex.compile(_CERTAIN), regex.compile("(?r)" + _CERTAIN)


def vocabulary(path: str = TOKENIZERS) -> bytes:
    """The vocabulary's file, below a megabyte."""
    with open(f"{path}/byte_bpe_50k.tiktoken", "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def encoding(path: str = TOKENIZERS) -> tiktoken.Encoding:
    """The byte_bpe_50k encoder; text that spells a special token is ordinary text."""
    return encoder(vocabulary(path))


@lru_cache(maxsize=4)
def encoder(held: bytes) -> tiktoken.Encoding:
    """The encoder of a vocabulary's file."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, held.splitlines())}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def last_certain(text: str) -> int:
    """The last certain boundary inside ``text``, 0 if there is none; the window grows from the end."""
    w = 64
    while True:
        at = max(0, len(text) - w)
        # two characters of context on either side keep every look-around inside the window
        m = CERTAIN_BACKWARDS.search(text, at)
        if m and (m.start() > at + 1 or at == 0):
            return m.start()
        if at == 0:
            return 0
        w *= 4


def first_certain(text: str) -> int:
    """The first certain boundary inside ``text``, its length if there is none."""
    w = 64
    while True:
        for m in CERTAIN.finditer(text[: w + 2]):
            if 0 < m.start() < w:
                return m.start()
        if w >= len(text):
            return len(text)
        w *= 4


class Element(NamedTuple):
    """An encoded piece: its windows (one and the same text where ``tail`` is None, as it has no certain boundary), and its ids or their number."""

    head: str
    tail: str | None
    ids: list[int] | int


def element(enc: tiktoken.Encoding, text: str, head: bool = True, tail: bool = True) -> Element:
    """The element of a leaf; windows that nothing will be joined to may be left out."""
    return Element(*windows(text, head, tail), enc.encode_ordinary(text))


def windows(text: str, head: bool = True, tail: bool = True) -> tuple[str, str | None]:
    """What stands before the first certain boundary and behind the last; nothing for a window that is not asked for."""
    q = first_certain(text) if head or not tail else 0
    p = last_certain(text) if tail else 0
    return (text, None) if q == len(text) or tail and p == 0 else (text[:q], text[p:] if tail else "")


def combine(enc: tiktoken.Encoding, a: Element, b: Element) -> Element:
    """The monoid's operation: the element of the concatenation of two neighbours."""
    if a.tail is None and not a.head:
        return b
    if b.tail is None and not b.head:
        return a
    left = a.head if a.tail is None else a.tail
    gone, new, skip = (len(enc.encode_ordinary(left)), enc.encode_ordinary(left + b.head), len(enc.encode_ordinary(b.head)))
    ids = a.ids - gone + len(new) + b.ids - skip if isinstance(a.ids, int) else [*a.ids[: len(a.ids) - gone], *new, *b.ids[skip:]]
    if a.tail is None and b.tail is None:
        return Element(*windows(a.head + b.head), ids)
    return Element(a.head if a.tail is not None else a.head + b.head, b.tail if b.tail is not None else a.tail + b.head, ids)


def join(enc: tiktoken.Encoding, left: tuple[str, list[int]], right: tuple[str, list[int]]) -> tuple[str, list[int]]:
    """Text and ids of the concatenation of two encoded neighbours."""
    (a, ia), (b, ib) = left, right
    return a + b, combine(enc, Element(*windows(a), ia), Element(*windows(b), ib)).ids


def encode_tree(enc: tiktoken.Encoding, text: str, leaf: int = LEAF, head: bool = True, tail: bool = True) -> Element:
    """The element of a text: halves recursively down to ``leaf`` characters, then joins up the tree."""
    if len(text) <= leaf:
        return element(enc, text, head, tail)
    half = len(text) // 2
    return combine(enc, encode_tree(enc, text[:half], leaf, head, True), encode_tree(enc, text[half:], leaf, True, tail))


def encode_text(enc: tiktoken.Encoding, text: str, leaf: int = LEAF) -> list[int]:
    """Ids of one text."""
    return encode_tree(enc, text, leaf, False, False).ids


def decode_tree(enc: tiktoken.Encoding, ids: list[int]) -> bytes:
    """The bytes of ``ids``: decoding is a homomorphism, so halves are decoded and concatenated."""
    if len(ids) <= LEAF:
        return enc.decode_bytes(ids)
    return decode_tree(enc, ids[: len(ids) // 2]) + decode_tree(enc, ids[len(ids) // 2 :])


def _elements(held, counts: bool, leaf: int, segment: int):
    """Rows (_key, _pos, _n, _head, _tail, _value) of the segments of each text; windows are kept where a text has several."""
    names = ["_key", "_pos", "_n", "_head", "_tail", "_value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(held.value)
        for b in batches:
            at, pos, n, heads, tails, values = [], [], [], [], [], []
            for k, text in enumerate(b.column("_text").to_pylist()):
                parts = range(0, len(text or ""), segment) or [0]
                for p in parts:
                    e = encode_tree(enc, (text or "")[p : p + segment], leaf, len(parts) > 1, len(parts) > 1)
                    at.append(k)
                    pos.append(p // segment)
                    n.append(len(parts))
                    heads.append(e.head if len(parts) > 1 else None)
                    tails.append(e.tail if len(parts) > 1 else None)
                    values.append(e.ids)
            sizes = np.fromiter(map(len, values), np.int64, len(values))
            if counts:
                value = pa.array(sizes)
            else:
                flat = np.fromiter(chain.from_iterable(values), np.int32, int(sizes.sum()))
                value = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            cols = [b.column("_key").take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(n, pa.int32()), pa.array(heads, pa.string()), pa.array(tails, pa.string()), value]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _pair(held, counts: bool):
    """Two neighbours, or the last one alone, as one element."""

    def run(pdf):
        enc = encoder(held.value)
        pdf = pdf.sort_values("_pos")
        rows = [Element(h, t, int(v) if counts else list(v)) for h, t, v in zip(pdf["_head"], pdf["_tail"], pdf["_value"])]
        e = rows[0] if len(rows) == 1 else combine(enc, *rows)
        return pd.DataFrame({"_key": pdf["_key"].iloc[:1].tolist(), "_pos": [int(pdf["_pos"].iloc[0]) // 2], "_head": [e.head], "_tail": [e.tail], "_value": [e.ids]})

    return run


def encode(df: DataFrame, key: str, text: str, out: str = "ids", counts: bool = False, tokenizers: str = TOKENIZERS, leaf: int = LEAF, segment: int = SEGMENT) -> DataFrame:
    """``key`` and the ids (or with ``counts`` their number) of ``text`` for every row of ``df``.

    Null and empty texts give an empty list (0). ``key`` must be unique; other columns of ``df`` are ignored, whatever
    their names. Rows are independent, so equal texts and ties need no care. Texts are read once; only segments of texts above
    ``segment`` characters are shuffled, level by level. The vocabulary is read here and sent to the tasks.
    """
    held = df.sparkSession.sparkContext.broadcast(vocabulary(tokenizers))
    kind, value = dict(df.dtypes)[key], "bigint" if counts else "array<int>"
    base = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = cut(base.mapInArrow(_elements(held, counts, leaf, segment), f"_key {kind}, _pos int, _n int, _head string, _tail string, _value {value}"))
    done = rows.filter("_n = 1").select("_key", "_value")
    level, most = rows.filter("_n > 1").drop("_n"), rows.agg(F.max("_n")).first()[0] or 1
    while most > 1:
        level = level.groupBy("_key", F.expr("_pos div 2").alias("_two")).applyInPandas(_pair(held, counts), f"_key {kind}, _pos int, _head string, _tail string, _value {value}")
        most = -(-most // 2)
    return done.unionByName(level.select("_key", "_value")).select(F.col("_key").alias(key), F.col("_value").alias(out))
