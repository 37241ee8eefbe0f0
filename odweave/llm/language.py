"""Language identification: script ranges, per-word scores, and a Viterbi path over the words of mixed texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.llm.tables import texts

#: Hashed features per language; with it the model's size is fixed per language.
SLOTS = 1 << 16
#: Labelled documents that a model is fitted on at most: those with the smallest hash of their id.
FIT_DOCUMENTS = 20_000
#: Tasks that count the sample.
FIT_TASKS = 32
#: What a change of language between two words costs, in natural log likelihood.
SWITCH = 6.0
#: A text whose language has less than this share of its letters is rejected; texts half in one language and half in another stay.
LEAST_SHARE = 0.3
#: A text with less than this share of its letters in scripts that the model has learned is rejected.
KNOWN_SHARE = 0.5
_OTHER = "other"
# The blocks of Unicode that hold the letters of a script.
_SCRIPTS = {
    "latin": [(0x0041, 0x024F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)], "greek": [(0x0370, 0x03FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x0400, 0x052F)], "armenian": [(0x0530, 0x058F)], "hebrew": [(0x0590, 0x05FF)],
    "arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)], "devanagari": [(0x0900, 0x097F)],
    "bengali": [(0x0980, 0x09FF)], "tamil": [(0x0B80, 0x0BFF)], "telugu": [(0x0C00, 0x0C7F)], "thai": [(0x0E00, 0x0E7F)],
    "georgian": [(0x10A0, 0x10FF)], "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)], "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}
SCRIPT_NAMES = [_OTHER, *_SCRIPTS]


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: its lower-case letter (0: no letter), and its script's number."""
    lower = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            y = x.lower()
            lower[c] = ord(y) if len(y) == 1 else c
    script = np.zeros(0x110000, dtype=np.uint8)
    for k, ranges in enumerate(_SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = k
    return lower, script


@dataclass(frozen=True)
class Words:
    """The words (runs of letters) of several texts, as one array: where they start, their text, letters and script."""

    starts: np.ndarray
    text: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    points: np.ndarray
    word: np.ndarray

    @classmethod
    def of(cls, batch: list[str]) -> Words:
        lower, scripts = _letters()
        raw = np.frombuffer("\n".join(batch).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        ends = np.cumsum([len(t) + 1 for t in batch])
        points = np.concatenate([[0], lower[raw], [0, 0]]).astype(np.uint32)  # a border before and after
        is_letter = points[1:-1] > 0
        begin = np.flatnonzero(is_letter & ~np.concatenate([[False], is_letter[:-1]]))
        stop = np.flatnonzero(is_letter & ~np.concatenate([is_letter[1:], [False]])) + 1
        return cls(begin, np.searchsorted(ends, begin, side="right"), stop - begin, scripts[raw[begin]] if len(raw) else begin.astype(np.uint8), points, stop)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each letter (it with its two neighbours, a border counts as one) and where each word's slots start."""
        p = self.points.astype(np.uint64)
        mixed = (p[:-2] * np.uint64(0x9E3779B1) + p[1:-1]) * np.uint64(0x85EBCA77) + p[2:]
        mixed = mixed * np.uint64(0xC2B2AE3D27D4EB4F)
        slots = (mixed >> np.uint64(48)).astype(np.uint32) & np.uint32(SLOTS - 1)
        inside = slots[np.flatnonzero(self.points[1:-1])]
        return inside, np.concatenate([[0], np.cumsum(self.letters)[:-1]]).astype(np.int64) if len(self.letters) else self.letters


@dataclass(frozen=True)
class Model:
    """Log probabilities (slot, language), the languages' names, and which languages each script was seen in."""

    languages: list[str]
    weights: np.ndarray
    scripts: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """(word, language): log likelihoods; languages never seen in the word's script are out, unless none was."""
        slots, starts = words.features()
        if not len(starts):
            return np.zeros((0, len(self.languages)))
        found = np.add.reduceat(self.weights[slots], starts, axis=0)
        allowed = self.scripts[words.script]
        allowed |= ~allowed.any(axis=1, keepdims=True)
        return np.where(allowed, found, -1e9)


def viterbi(scores: np.ndarray, text: np.ndarray, switch: float) -> np.ndarray:
    """The best path of languages through the words of each text; a change between neighbours costs ``switch``.

    All texts go forward together, word by word; texts are ordered by length, so each step is one operation on those
    that still have words.
    """
    n, languages = scores.shape
    if not n:
        return np.zeros(0, dtype=np.int64)
    begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    length = np.diff(np.concatenate([begin, [n]]))
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    alive = len(length) - np.searchsorted(length[::-1], np.arange(length[0]), side="right")
    back = np.empty((n, languages), dtype=np.int16)
    value = scores[begin].copy()
    stay = np.arange(languages)
    for k in range(1, int(length[0])):
        a = alive[k]
        best = value[:a].argmax(axis=1)
        jump = value[np.arange(a), best] - switch
        moves = jump[:, None] > value[:a]
        at = begin[:a] + k
        back[at] = np.where(moves, best[:, None], stay)
        value[:a] = np.where(moves, jump[:, None], value[:a]) + scores[at]
    path = np.empty(n, dtype=np.int64)
    now = value.argmax(axis=1)
    for k in range(int(length[0]) - 1, -1, -1):
        a = alive[k]
        at = begin[:a] + k
        path[at] = now[:a]
        if k:
            now[:a] = back[at, now[:a]]
    return path


def spans(model: Model, batch: list[str], switch: float = SWITCH) -> list[list[tuple[int, int, str]]]:
    """Per text the runs of words of one language: (first code point, end, language)."""
    words = Words.of(batch)
    path = viterbi(model.scores(words), words.text, switch)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in batch])])
    out: list[list[tuple[int, int, str]]] = [[] for _ in batch]
    for k, (t, a, b) in enumerate(zip(words.text.tolist(), words.starts.tolist(), words.word.tolist(), strict=True)):
        name, a, b = model.languages[path[k]], a - int(offsets[t]), b - int(offsets[t])
        if out[t] and out[t][-1][2] == name:
            out[t][-1] = (out[t][-1][0], b, name)
        else:
            out[t].append((a, b, name))
    return out


def _held(model: Model, batch: list[str], switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray]:
    """Letters per (text, language) along the path: all, and those of words in a script that some language was seen in."""
    words = Words.of(batch)
    path = viterbi(model.scores(words), words.text, switch)
    held, known = np.zeros((2, len(batch), len(model.languages)))
    np.add.at(held, (words.text, path), words.letters)
    np.add.at(known, (words.text, path), words.letters * model.scripts.any(axis=1)[words.script])
    return held, known


def label(model: Model, batch: list[str], switch: float = SWITCH) -> tuple[list[str], np.ndarray]:
    """Per text the language of most of its letters along the path (`und` without letters), and its share of them."""
    held, _ = _held(model, batch, switch)
    total = held.sum(axis=1)
    names = [model.languages[k] if n else "und" for k, n in zip(held.argmax(axis=1).tolist(), total.tolist(), strict=True)]
    return names, np.divide(held.max(axis=1, initial=0), total, out=np.zeros(len(batch)), where=total > 0)


def held_out(key: str = "doc_id"):
    """Rows of which a model never learns: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, most: int = FIT_DOCUMENTS) -> Model:
    """Learns from text and lang of rows of ``docs`` that are not held out and have both.

    At most about ``most`` rows (documented bound), each with its whole text. The bound is shared out by language: each gets
    an equal part, or all its rows where they are fewer, and what such languages leave goes to the others; so a rare language
    is learned at every size. Within a language the rows are chosen by a hash of their doc_id (of the text where it is
    missing). Counts of hashed letter triples are summed per task, then per language; the driver gets one array per language.
    """
    rows = docs.select("doc_id", "text", "lang").filter(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    odds, left = {}, most
    sizes = sorted((r.asDict()["count"], r.lang) for r in rows.groupBy("lang").count().collect())
    for k, (n, name) in enumerate(sizes):
        part = min(n, left // (len(sizes) - k))
        odds[name], left = part / n, left - part
    if not odds:
        return Model([], np.zeros((SLOTS, 0), dtype=np.float32), np.zeros((len(SCRIPT_NAMES), 0), dtype=bool))
    draw = F.pmod(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text")), F.lit(1 << 40))
    share = F.create_map(*(F.lit(x) for pair in odds.items() for x in pair))
    chosen = rows.filter(draw < F.element_at(share, F.col("lang")) * float(1 << 40)).repartition(FIT_TASKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for name in set(langs.tolist()):
                words = Words.of(texts(batch.column(0).filter(pa.array(langs == name))))
                slots, scripts = found.setdefault(name, (np.zeros(SLOTS, dtype=np.int64), np.zeros(len(SCRIPT_NAMES), dtype=np.int64)))
                slots += np.bincount(words.features()[0], minlength=SLOTS)
                scripts += np.bincount(words.script, weights=words.letters, minlength=len(SCRIPT_NAMES)).astype(np.int64)
        if found:
            data = [np.concatenate(v).tobytes() for v in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(data, pa.binary())], ["lang", "counts"])

    def total(rows: pa.Table) -> pa.Table:
        summed = sum(np.frombuffer(x, dtype=np.int64) for x in rows["counts"].to_pylist())
        return pa.table({"lang": rows["lang"][:1], "counts": pa.array([summed.tobytes()], pa.binary())})

    schema = "lang string, counts binary"
    per = chosen.select("text", "lang").mapInArrow(count, schema).groupBy("lang").applyInArrow(total, schema).collect()
    found = {r.lang: np.frombuffer(r.counts, dtype=np.int64) for r in sorted(per, key=lambda r: r.lang)}
    counts = np.stack([v[:SLOTS] for v in found.values()], axis=1) + 0.1
    scripts = np.stack([v[SLOTS:] for v in found.values()], axis=1)
    return Model(list(found), np.log(counts / counts.sum(axis=0)).astype(np.float32), scripts * 200 > scripts.sum(axis=0))


def _names(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    batch = texts(column)
    if not model.languages:
        return ["und"] * len(batch), np.zeros(len(batch))
    return label(model, batch)


def _parts(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about so many letters, so that arrays over its letters stay small."""
    sizes = np.cumsum([len(t or "") for t in batch.column(column).to_pylist()])
    marks = np.flatnonzero(np.diff(sizes // most, prepend=0)).tolist() if len(sizes) else []
    edges = sorted({0, *marks, batch.num_rows})
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def predict(docs: DataFrame, model: Broadcast) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score (the share of the letters).

    Only the text decides. A missing text or one without letters is `und` with score 0; so is every text for a model without
    languages; a tie goes to the first name; a missing doc_id stays missing; repeated rows are predicted one by one; an
    empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in _parts(b, 2)):
            names, scores = _names(model.value, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text")).select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def known(model: Model, batch: list[str], least: float = LEAST_SHARE) -> np.ndarray:
    """Per text: are half of its letters or more in learned scripts, and ``least`` of all in one language's words there?

    A text without letters is not known, and none is to a model without languages. A language never learned whose script was
    learned is not told from the learned ones.
    """
    if not model.languages:
        return np.zeros(len(batch), dtype=bool)
    held, found = _held(model, batch)
    total = held.sum(axis=1)
    return (total > 0) & (found.sum(axis=1) >= KNOWN_SHARE * total) & (found.max(axis=1) >= least * total)


def keep(docs: DataFrame, model: Broadcast, least: float = LEAST_SHARE) -> DataFrame:
    """The rows of ``docs``, with all columns, that are ``known``."""
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in _parts(b, column)):
            yield batch.filter(pa.array(known(model.value, texts(batch.column(column)), least)))

    return docs.mapInArrow(run, docs.schema)
