"""Languages of documents and of their paragraphs by string kernels.

The prose of a paragraph (its words without code, names, paths and logs) is the set of its character n-grams of two lengths; the
kernel of two paragraphs is the share of n-grams they have in common, |x & y| / sqrt(|x| |y|). Landmarks drawn from labelled
rows span the space (Nyström), a ridge regression onto them separates each language from the rest. Since the kernel is linear in
the n-gram presences, a batch of paragraphs is scored by one product of presences with (landmarks x weights).

The model is fitted on at most PER_LABEL labelled documents a language; labels may be wrong, so that rows on which a first
fit disagrees are left out of a second one. Everything else covers all documents.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The nine languages.
LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pt", "ru", "zh")
#: Most labelled documents of a language that serve to fit the model, and most paragraphs of each.
PER_LABEL, PER_DOC = 250, 8
LANDMARKS = 450
LENGTHS, BITS = (2, 3), 15
RIDGE = 1e-3
LEAST_LETTERS = 20
#: A document with fewer letters of prose has none.
LEAST_OF_ALL = 12
#: A longer run of Latin letters is no word.
LONGEST_WORD = 40
#: A row leaves the second fit if the first prefers another language by more than this.
MARGIN = 0.6
#: Three-letter codes and English names of the nine.
NAMES = {
    "de": "deu ger german", "en": "eng english", "es": "spa spanish", "fr": "fra fre french", "it": "ita italian", "nl": "nld dut dutch", "pt": "por portuguese", "ru": "rus russian", "zh": "zho chi cmn chinese",
}
ALIASES = {a: k for k, v in NAMES.items() for a in (k, *v.split())}
SPACES = str.maketrans({c: " " for c in ",;!?\"'’‘´«»“”„‚–—*~|…·•，。！？；：、（）「」『』《》【】​﻿\xa0\u2003"})
FENCE = re.compile(r"(?:```|~~~)")
INLINE = re.compile(r"`[^`\n]*`|\w+://\S+")
HAN = re.compile(r"[㐀-鿿]")
CODE_LINE = re.compile(r"[;{}]\s*$|^\s*(?:at \S+ \(|\[\d\d:\d\d|\S+\(.*\)\s*$|[|+]-|\$ |>>> |\+\+\+ |--- |@@ |diff |index [0-9a-f]{6}|(?:import|from|return|def|func|fn|class|const|let|var|if|for|while|end|else|elif|local|package|use|using|#include)\b(?=.*[(){}=:;/]))")


def label_of(raw: str | None) -> str | None:
    """The language that a label names in any spelling; None for no label (null, empty, und, unknown), "?" for another one."""
    s = (raw or "").strip().lower()
    if s in ("", "und", "unknown"):
        return None
    return ALIASES.get(re.split(r"[-_ (]", s)[0], "?")


def label_column(c: str):
    """``label_of`` as a column."""
    first = F.regexp_extract(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"^[^-_ (]*", 0)
    m = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.try_element_at(m, first)


def paragraphs(text: str) -> Iterator[tuple[int, str]]:
    """(number from 1, paragraph) of the maximal runs of lines that are not blank, without the fenced ones' code."""
    number, lines, fenced = 0, [], False
    for line in [*re.split(r"\r\n|\r|\n", text), ""]:
        if line.strip():
            if FENCE.match(line.lstrip()):
                fenced = not fenced
                lines.append("")
            else:
                lines.append("" if fenced else line)
        elif lines:
            number += 1
            yield number, "\n".join(lines)
            lines = []


def prose(paragraph: str) -> tuple[str, int]:
    """The words of a paragraph that are prose, lower case, and their letters (a Chinese character counts as three)."""
    kept = "\n".join(x for x in paragraph.split("\n") if x and not CODE_LINE.search(x))
    if "`" in kept or "://" in kept:
        kept = INLINE.sub(" ", kept)
    words = []
    for w in kept.translate(SPACES).split():
        if not w.isalpha():
            w = w.strip(".:()[]#>+%&/-")
            if not w.isalpha():
                continue
        if len(w) > LONGEST_WORD and w.isascii() or len(w) > 3 and len(set(w)) == 1:
            continue
        if w.islower() or w[1:].islower() or w.isupper() or len(w) == 1 or not w.isascii() and HAN.search(w):
            words.append(w)
    out = " ".join(words).lower()
    n = len(out) - max(len(words) - 1, 0)
    return out, n if out.isascii() else n + 2 * len(HAN.findall(out))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text as numbers below 2^BITS, one after another, and where each text's begin (one more than texts)."""
    sizes = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    chars = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)
    keys = []
    with np.errstate(over="ignore"):
        for n in LENGTHS:
            if len(chars) < n:
                continue
            h = np.full(len(chars) - n + 1, n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + chars[k : len(chars) - n + 1 + k]
            h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
            same = owner[: len(h)] == owner[n - 1 :]
            keys.append(((owner[: len(h)] << np.uint64(BITS)) | h)[same])
    flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    flat = np.sort(flat)
    flat = flat[np.concatenate([[True], flat[1:] != flat[:-1]])] if len(flat) else flat
    cuts = np.searchsorted(flat, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(BITS))
    return (flat & np.uint64((1 << BITS) - 1)).astype(np.int64), cuts


def scores(weights: np.ndarray, texts: list[str]) -> np.ndarray:
    """Each text's score for each language: presences times (landmarks x weights), by the kernel's norm."""
    flat, cuts = grams(texts)
    sizes = np.diff(cuts)
    sums = np.add.reduceat(np.concatenate([weights[flat], np.zeros((1, weights.shape[1]), np.float32)]), np.minimum(cuts[:-1], len(flat)), axis=0) if len(texts) else np.zeros((0, weights.shape[1]))
    sums[sizes == 0] = 0
    return sums / np.sqrt(np.maximum(sizes, 1))[:, None]


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS) -> np.ndarray:
    """Weights (2^BITS x languages) fitted on labelled prose, in two rounds."""
    y = np.array([LANGUAGES.index(x) for x in labels], np.int64)
    flat, cuts = grams(texts)
    size = np.maximum(np.diff(cuts), 1)
    own = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def round_of(use: np.ndarray) -> np.ndarray:
        if not len(use):
            return np.zeros((1 << BITS, len(LANGUAGES)), np.float32)
        by = [[i for i in use if y[i] == k] for k in range(len(LANGUAGES))]
        marks = [i for rows in by for i in rows[: -(-landmarks // len(LANGUAGES))]]
        phi = np.zeros((1 << BITS, len(marks)), np.float32)
        for j, i in enumerate(marks):
            phi[own[i], j] = 1 / np.sqrt(size[i])
        kernel = np.stack([phi[own[i]].sum(axis=0) / np.sqrt(size[i]) for i in use])
        inner = np.stack([phi[own[i]].sum(axis=0) / np.sqrt(size[i]) for i in marks])
        target = np.where(y[use][:, None] == np.arange(len(LANGUAGES)), 1.0, -1.0)
        weight = (1 / np.maximum(np.bincount(y[use], minlength=len(LANGUAGES)), 1))[y[use]]
        weight *= len(use) / weight.sum()
        left = kernel.T @ (kernel * weight[:, None]) + RIDGE * len(use) * inner + 1e-6 * np.eye(len(marks))
        alpha = np.linalg.solve(left.astype(np.float64), kernel.T @ (target * weight[:, None]))
        return (phi @ alpha).astype(np.float32)

    everyone = np.arange(len(texts))
    first = round_of(everyone)
    s = np.stack([first[x].sum(axis=0) / np.sqrt(k) for x, k in zip(own, size)]) if len(own) else np.zeros((0, len(LANGUAGES)))
    return round_of(everyone[s.max(axis=1, initial=-9) - s[everyone, y] <= MARGIN])


def model_for(documents: DataFrame) -> np.ndarray:
    """The weights for ``documents(doc_id, text, lang)``: fitted on the PER_LABEL labelled documents of each language whose ids hash lowest."""
    labelled = documents.select("doc_id", label_column("lang").alias("label"), F.xxhash64("doc_id").alias("h")).filter("label is not null")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h", "doc_id"))
    some = labelled.withColumn("rn", rank).filter(F.col("rn") <= PER_LABEL).select("doc_id", "label", "h")
    rows = documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(some), "doc_id").orderBy("h", "doc_id").limit(PER_LABEL * len(LANGUAGES)).collect()
    texts, labels = [], []
    for r in rows:
        taken = 0
        for _, p in paragraphs(r["text"]):
            words, letters = prose(p)
            if letters >= 40:
                texts.append(words)
                labels.append(r["label"])
                taken += 1
                if taken == PER_DOC:
                    break
    return fit(texts, labels)


SCHEMA = "doc_id bigint, segment int, lang string, confidence double, label string, letters bigint"


def _classify(model, cases_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value
        for b in batches:
            ids, texts, raw = (b.column(c).to_pylist() for c in ("doc_id", "text", "lang"))
            at = 0
            while at < len(ids):
                end, size, docs, words, letters, numbers = at, 0, [], [], [], []
                while end < len(ids) and size < 1 << 20:  # enough for whole arrays, little enough for memory
                    t = texts[end] or ""
                    size += len(t)
                    for n, p in paragraphs(t):
                        w, k = prose(p)
                        if k >= 2:
                            docs.append(end)
                            words.append(w)
                            letters.append(k)
                            numbers.append(n)
                    end += 1
                yield _rows(weights, ids, raw, docs, words, letters, numbers, at, end, cases_only)
                at = end

    return run


def _rows(weights, ids, raw, docs, words, letters, numbers, at, end, cases_only) -> pa.RecordBatch:
    s = scores(weights, words)
    best = s.argmax(axis=1) if len(words) else np.zeros(0, int)
    odds = np.exp(4 * (s - s.max(axis=1, keepdims=True))) if len(words) else s
    sure = odds.max(axis=1) / odds.sum(axis=1) if len(words) else np.zeros(0)
    docs_, letters_ = np.array(docs, np.int64) - at, np.array(letters, np.float64)
    total = np.zeros((end - at, len(LANGUAGES)))
    counted = letters_ >= LEAST_LETTERS
    for only in (counted, ~counted):  # shorter paragraphs decide only where there is nothing longer
        use = only & (total.sum(axis=1)[docs_] == 0) if only is not counted else only
        np.add.at(total, (docs_[use], best[use]), letters_[use])
    main, mass = total.argmax(axis=1), total.sum(axis=1)
    out = []
    for d in range(end - at):
        if mass[d] >= LEAST_OF_ALL:
            label = label_of(raw[at + d])
            lang = LANGUAGES[main[d]]
            if not cases_only or label != lang:
                out.append((ids[at + d], 0, lang, float(total[d, main[d]] / mass[d]), label, int(mass[d])))
    for k in np.flatnonzero(counted & (best != main[docs_])) if len(words) else ():
        out.append((ids[docs[k]], numbers[k], LANGUAGES[best[k]], float(sure[k]), None, letters[k]))
    cols = list(zip(*out)) if out else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.int64()))], ["doc_id", "segment", "lang", "confidence", "label", "letters"])


def languages(documents: DataFrame, cases_only: bool = False) -> DataFrame:
    """(doc_id, segment, lang, confidence, label, letters): segment 0 for each document with prose, and its paragraphs in another language.

    A document's language is the one with most letters of prose, its confidence that share of them; a paragraph's
    confidence is the softmax of its scores. With ``cases_only`` segment 0 appears only where the label is missing or names
    another language. Null, empty and blank texts and texts without prose give no rows. Extra columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    model = documents.sparkSession.sparkContext.broadcast(model_for(docs))
    return docs.filter("text is not null").mapInArrow(_classify(model, cases_only), SCHEMA)
