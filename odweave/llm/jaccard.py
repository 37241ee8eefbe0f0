"""Exact Jaccard join of word-shingle sets by set-relation skipping.

Sets are ordered by how often their shingles occur (a fixed-size table of counts over all documents), rarest first. Two sets
that reach the threshold share a shingle of their prefixes. The index list of a prefix shingle is sorted by set size; whole
ranges are skipped that sizes and prefix positions rule out. What the lists leave are bundles of sets that may be linked.
The counters are shared by many shingles, so in a large table the order blurs and lists tie sets that have little in common: a
bundle too large for one block is taken apart again by an order that is counted among its own sets alone.
Within a bundle the answers of each set are derived from those of a leader set: only the shingles by which sets differ from the
leader are compared. What stays large is cut into blocks, and each pair of blocks is a task of bounded size; no pairs are listed.
Shuffle files go when the step that wrote them ends; blocks are compared in as many steps as keep a step's texts below the input's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odweave.llm.components import components
from odweave.llm.shingles import mixed, shingles, word_hashes
from odweave.llm.tables import runs, texts
from odweave.session import materialize, materialize_each, shuffles_freed, whole_if_small

#: Counters of the table of shingle counts, and counters that travel together.
SLOTS, CHUNK = 1 << 22, 4096
#: Tasks whose counters are summed in one group before the groups are, and sets a task remembers to have posted.
SUM_TASKS, POSTED = 512, 200_000
#: Sets and shingles of one block of a bundle.
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 20
#: Shingles of the texts that a step of the comparison shuffles, if the whole input has fewer.
STEP_SHINGLES = 1 << 24
#: Bits of the table that tells where a row is looked for.
MARKS = 1 << 26
_COLUMNS = 4096


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct shingles, ascending. A-Z count as lower case; words end at ASCII white space."""
    return np.unique(shingles(word_hashes(text.encode().lower().split()), words))


def _salted(found: np.ndarray, salt: int | None) -> np.ndarray:
    """The set under other hashes, ascending: sets of different salts share none of them, nor their counters."""
    return np.sort(mixed(found + np.uint64(salt & 0xFFFFFFFFFFFFFFFF))) if salt else found


def _sets(batch: pa.RecordBatch, words: int) -> list[np.ndarray]:
    """The sets of the rows' texts, under the rows' salts if there are any."""
    salts = batch.column("salt").to_pylist() if "salt" in batch.schema.names else [None] * batch.num_rows
    return [_salted(shingle_set(t, words), salt) for t, salt in zip(texts(batch.column("text")), salts, strict=True)]


def _narrow(counts: np.ndarray) -> bytes:
    """Counters in as few bytes as the largest needs, packed."""
    return zlib.compress(counts.astype(np.min_scalar_type(int(counts.max()))).tobytes(), 1)


def _wide(packed: bytes) -> np.ndarray:
    raw = zlib.decompress(packed)
    return np.frombuffer(raw, dtype=f"u{len(raw) // CHUNK}").astype(np.int64)


def _slots(found: np.ndarray) -> np.ndarray:
    return (found & np.uint64(SLOTS - 1)).astype(np.int64)


def _sum_of(found: np.ndarray) -> int:
    return int(found.sum(dtype=np.uint64).view(np.int64))


def _mix_of(found: np.ndarray) -> int:
    mixed = (found ^ (found >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return int(np.bitwise_xor.reduce(mixed, initial=np.uint64(0)).view(np.int64))


def _profiles(docs: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """Per row: row, doc_id, n, and two hashes of its set; and how many sets hold each slot's shingles. ``docs``: row, doc_id, text, perhaps salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, dtype=np.uint32)
        names = ["row", "doc_id", "n", "s1", "s2", "chunk", "part", "counts"]
        for batch in (b.slice(a, 500) for b in batches for a in range(0, b.num_rows, 500)):
            sets = _sets(batch, words)
            np.add.at(counts, _slots(np.concatenate(sets)), np.uint32(1))
            n = pa.array([len(s) for s in sets], pa.int64())
            s1, s2 = (pa.array([f(s) for s in sets], pa.int64()) for f in (_sum_of, _mix_of))
            none = pa.nulls(len(sets), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, s1, s2, none, none, pa.nulls(len(sets), pa.binary())], names)
        used = np.flatnonzero(counts.reshape(-1, CHUNK).any(axis=1))
        packed = [_narrow(counts[k * CHUNK : (k + 1) * CHUNK]) for k in used.tolist()]
        empty, part = pa.nulls(len(used), pa.int64()), [TaskContext.get().partitionId() // SUM_TASKS] * len(used)
        yield pa.RecordBatch.from_arrays([empty, empty, empty, empty, empty, pa.array(used, pa.int32()), pa.array(part, pa.int32()), pa.array(packed, pa.binary())], names)

    def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed = np.zeros(CHUNK, dtype=np.int64)
        for packed in (x for b in batches for x in b.column("counts").to_pylist()):
            summed += _wide(packed)
        yield pa.RecordBatch.from_pydict({"chunk": key[:1], "counts": pa.array([_narrow(summed)], pa.binary())})

    schema = "row bigint, doc_id bigint, n bigint, s1 bigint, s2 bigint, chunk int, part int, counts binary"
    stored = materialize(docs.mapInArrow(run, schema))
    counts = np.zeros(SLOTS, dtype=np.int64)
    sums = stored.filter("chunk is not null").select("chunk", "part", "counts")
    for keys in (("chunk", "part"), ("chunk",)):
        sums = sums.groupBy(*keys).applyInArrow(total, "chunk int, counts binary")
    for row in sums.collect():
        counts[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = _wide(row.counts)
    return stored.filter("chunk is null").select("row", "doc_id", "n", "s1", "s2"), np.minimum(counts, 0xFFFFFFFF).astype(np.uint32)


def prefix(found: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, in order, one of which every set that reaches the threshold shares in its own prefix."""
    n = len(found)
    order = np.lexsort((found, counts[_slots(found)]))
    return found[order[: n - -(-percent * n // 100) + 1]] if n else found


def _postings(docs: DataFrame, counts: Broadcast, words: int, percent: int) -> DataFrame:
    """The prefix shingles: token, row, n, place. A task posts equal sets once, whichever of their rows comes first. ``docs``: row, text, perhaps salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posted: set[tuple[int, int]] = set()
        for batch in batches:
            for part in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
                sets, new = _sets(part, words), []
                for k, found in enumerate(sets):
                    mark = _sum_of(found), _mix_of(found)
                    if mark not in posted:
                        posted.add(mark)
                        new.append(k)
                if len(posted) > POSTED:
                    posted.clear()
                part, sets = part.take(pa.array(new, pa.int64())), [sets[k] for k in new]
                heads = [prefix(s, counts.value, percent) for s in sets]
                sizes = np.array([len(h) for h in heads], dtype=np.int64)
                if sizes.sum():
                    keys = np.repeat(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), sizes)
                    n = np.repeat(np.array([len(s) for s in sets], dtype=np.int32), sizes)
                    place = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes.tolist()])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads).view(np.int64)), pa.array(keys), pa.array(n), pa.array(place)], ["token", "row", "n", "place"])

    return docs.mapInArrow(run, "token bigint, row bigint, n int, place int")


class ListSweep:
    """Goes once through index lists sorted by (token, n) and tells which postings may be linked to which.

    A partner of a set of n shingles has percent * n / 100 of them or more. A shingle at place p of the prefix leaves at most
    n - p common ones, which bounds the partner's size from above. A posting whose bound is below the smallest partner is
    skipped; one whose bound is below n can only be the larger of a pair. Each other posting is tied to the last one before it
    that can be the smaller of a pair, if sizes and reach allow any pair across that point.
    """

    def __init__(self, percent: int):
        self.percent, self.carry = percent, None

    def edges(self, token: np.ndarray, doc: np.ndarray, n: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, place = n.astype(np.int64), place.astype(np.int64)
        bound = (n - place) * (100 + self.percent) // self.percent - n
        low = -(-self.percent * n // 100)
        useful = bound >= low
        token, doc, n, bound, low = token[useful], doc[useful], n[useful], bound[useful], low[useful]
        if not len(token):
            return doc, doc
        if self.carry is not None:
            token, doc, n, bound, low = (np.concatenate([[c], x]) for c, x in zip(self.carry, (token, doc, n, bound, low), strict=True))
        ahead = bound >= n  # can be the smaller of a pair
        segment = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]]))
        last = np.maximum.accumulate(np.where(ahead, np.arange(len(token)), -1))
        reach = np.maximum.accumulate(np.where(ahead, bound, 0) + (segment << 33)) - (segment << 33)
        before = np.concatenate([[-1], last[:-1]])
        tied = (before >= 0) & (segment[before] == segment)
        tied[1:] &= (reach[:-1] >= n[1:]) & (n[before[1:]] >= low[1:])
        at = np.flatnonzero(tied)
        end = int(last[-1])
        if end >= 0:
            self.carry = token[end], doc[end], n[end], max(int(reach[-1]), int(n[end])) if segment[end] == segment[-1] else bound[end], low[end]
        return doc[before[at]], doc[at]


def _candidates(postings: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that hold all sets together that may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = ListSweep(percent)
        for batch in batches:
            if batch.num_rows:
                a, b = sweep.edges(*(batch.column(c).to_numpy() for c in ("token", "row", "n", "place")))
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    lists = postings.repartition("token").sortWithinPartitions("token", "n", "row")
    return lists.mapInArrow(run, "a bigint, b bigint").distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share, derived from a leader's answers.

    With L the leader, |x and y| = |L| - |L\\x| - |L\\y| + |L\\x and L\\y| + |x\\L and y\\L|: only differences are compared.
    """
    sizes = np.array([len(s) for s in sets])
    all_of, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    tokens, column, times = np.unique(all_of, return_inverse=True, return_counts=True)
    leader = int(np.bincount(owner, weights=times[column] > 1, minlength=len(sets)).argmax())
    led = np.zeros(len(tokens), dtype=bool)
    led[column[owner == leader]] = True
    with_leader = np.bincount(owner, weights=led[column], minlength=len(sets)).astype(np.int64)
    missing = sizes[leader] - with_leader
    base = sizes[leader] - missing[:, None] - missing[None, :]
    differing = np.where(led, len(sets) - times, times)
    columns = np.flatnonzero(differing > 1)
    position = np.full(len(tokens), -1)
    position[columns] = np.arange(len(columns))
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    place = position[column]
    for start in range(0, len(columns), _COLUMNS):
        here = (place >= start) & (place < start + _COLUMNS)
        matrix = np.zeros((len(sets), min(_COLUMNS, len(columns) - start)), dtype=np.float32)
        matrix[:, led[columns[start : start + _COLUMNS]]] = 1
        matrix[owner[here], place[here] - start] = ~led[column[here]]
        both += matrix @ matrix.T
    out = base + np.rint(both).astype(np.int64)
    np.fill_diagonal(out, sizes)  # differences that only one set has were left out
    return out


def _linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which two sets reach the threshold."""
    if len(sets) == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        yes = 100 * common >= percent * (len(sets[0]) + len(sets[1]) - common) and common > 0
        return np.array([[False, yes], [yes, False]])
    common, sizes = overlaps(sets), np.array([len(s) for s in sets])
    out = (100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)) & (common > 0)
    np.fill_diagonal(out, False)
    return out


def _roots(linked: np.ndarray) -> np.ndarray:
    """The first set that each one reaches."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            root[i], new = i, [i]
            while new:
                step = linked[new].any(axis=0) & (root < 0)
                root[step] = i
                new = np.flatnonzero(step).tolist()
    return root


def _verified(bundled: DataFrame, words: int, percent: int) -> DataFrame:
    """Per set and block pair: row, root (a set it reaches there), links (documents whose sets it is linked with there).

    ``bundled``: bundle, i, j (a pair of blocks), block (the set's own), row, copies, text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "bundle", "i", "j"):
            sets = [shingle_set(t, words) for t in texts(rows["text"])]
            linked = _linked(sets, percent) if len(sets) > 1 else np.zeros((1, 1), dtype=bool)
            if rows["i"][0].as_py() != rows["j"][0].as_py():  # pairs within a block are another task's
                block = rows["block"].to_numpy()
                linked &= block[:, None] != block[None, :]
            ids = rows["row"].to_numpy()
            links = linked @ rows["copies"].to_numpy()
            some = links > 0
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[_roots(linked)][some]), pa.array(links[some])], ["row", "root", "links"])

    keys = ["bundle", "i", "j"]
    ordered = bundled.repartition(*keys).sortWithinPartitions(*keys, "row")
    return ordered.mapInArrow(run, "row bigint, root bigint, links bigint")


def _marks(df: DataFrame, key: str) -> DataFrame:
    """Each row with the place of its key in a table of ``MARKS`` bits: a ``__word`` of 64 bits and the ``__bit`` in it."""
    at = F.pmod(F.xxhash64(key), F.lit(MARKS))
    return df.withColumns({"__word": F.shiftright(at, 6).cast("int"), "__bit": F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int"))})


def _looked_for(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``df`` with a column ``__likely``: true for each row whose key is in ``wanted``, and for few others unless that has a large part of ``MARKS`` keys.

    The table of bits is sent to the rows, which are not shuffled; it has one size at most, however many keys there are.
    """
    words = _marks(wanted, key).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    marked = _marks(df, key).join(F.broadcast(words), "__word", "left")
    return marked.withColumn("__likely", F.coalesce(F.col("__bits").bitwiseAND(F.col("__bit")) != 0, F.lit(False))).drop("__word", "__bit", "__bits")


def _with_text(some: DataFrame, rows: DataFrame) -> DataFrame:
    """``some`` of the rows, each with its text; the texts of few others are shuffled."""
    likely = _looked_for(rows.select("row", "text"), some.select("row"), "row").filter("__likely").drop("__likely")
    return some.join(likely, "row")


def _split(bundles: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Bundles (node, component), those of more sets than a block taken apart as long as that halves their pairs.

    The sets of one bundle go under hashes of its own, so that counts and lists are those among its sets. Two sets that are linked
    share a shingle of their prefixes in any order, so they stay together; a set that is left alone is linked with nothing.
    """
    context, before, step = rows.sparkSession.sparkContext, float("inf"), 0
    while True:
        sizes = materialize(bundles.groupBy("component").agg(F.count(F.lit(1)).alias("sets")).filter(F.col("sets") > BLOCK_SETS))
        pairs = sizes.agg(F.sum(F.col("sets").cast("double") * F.col("sets"))).first()[0] or 0
        if not pairs or 2 * pairs > before:
            return bundles
        before, step = pairs, step + 1
        salt = F.xxhash64("component", F.lit(step))
        large = materialize(bundles.join(sizes, "component").select(F.col("node").alias("row"), salt.alias("salt")))
        found = materialize(_with_text(large, rows).select("row", F.col("row").alias("doc_id"), "text", "salt"))
        _, counts = _profiles(found, words)
        finer = components(_candidates(_postings(found.select("row", "text", "salt"), context.broadcast(counts), words, percent), percent))
        bundles = materialize(bundles.join(large.select(F.col("row").alias("node")), "node", "left_anti").unionByName(finer))


def _groups(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row of the stored ``rows`` (row, a number of its own; doc_id; text): row, doc_id, n_shingles, component_id, n_links."""
    with shuffles_freed(rows.sparkSession):
        return _grouped(rows, words, percent)


def _grouped(rows: DataFrame, words: int, percent: int) -> DataFrame:
    profiles, counts = _profiles(rows, words)
    sets = ["s1", "s2", "n"]
    documents = profiles.filter("n > 0 and doc_id is not null").groupBy(*sets, "doc_id").agg(F.min("row").alias("row"))
    classes = documents.groupBy(*sets).agg(F.min("row").alias("rep"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes)
    known = F.col("doc_id").isNotNull()
    members = profiles.join(classes, sets, "left")
    members = materialize(members.select("row", "doc_id", "n", *(F.when(known, F.col(c)).alias(c) for c in ("rep", "least", "copies"))))

    context = rows.sparkSession.sparkContext
    postings = _postings(rows.filter("doc_id is not null").select("row", "text"), context.broadcast(counts), words, percent)
    to_rep = members.filter("rep is not null").select("row", "rep")
    at_a, at_b = (to_rep.select(F.col("row").alias(x), F.col("rep").alias(f"{x}_rep")) for x in ("a", "b"))
    between = _candidates(postings, percent).join(at_a, "a").join(at_b, "b").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
    bundles = _split(components(between), rows, words, percent)

    standing = members.filter("row = rep").select("row", "n", "copies")
    placed = materialize(bundles.select(F.col("node").alias("row"), F.col("component").alias("bundle")).join(standing, "row"))
    blocks = placed.groupBy("bundle").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    placed = placed.join(materialize(blocks), "bundle").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    shuffled, every = placed.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0, profiles.agg(F.sum("n")).first()[0] or 0
    steps = max(1, -(-shuffled // max(every, STEP_SHINGLES)))
    with_text = _with_text(placed, rows)
    with_text = with_text if steps == 1 else materialize(with_text)
    dealt = with_text.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bundled = dealt.select(
        "bundle", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "row", "copies", "text"
    )
    step = F.pmod(F.xxhash64("bundle", "i", "j"), F.lit(steps))
    verified = materialize_each(_verified(bundled.filter(step == k) if steps > 1 else bundled, words, percent) for k in range(steps))

    # Rows of one doc_id with different sets hold their classes together.
    held = members.filter("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z"))
    held = materialize(held.filter("a <> z").select("doc_id", "a"))
    same = held.join(members.select("doc_id", F.col("rep").alias("b")), "doc_id").select("a", "b").filter("a <> b").distinct()
    found = components(verified.select(F.col("row").alias("a"), F.col("root").alias("b")).unionByName(same)).withColumnRenamed("node", "rep")
    least = found.join(classes.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("component_id"))
    links = verified.groupBy(F.col("row").alias("rep")).agg(F.sum("links").alias("links"))
    reps = found.join(materialize(least), "component").join(links, "rep", "left").select("rep", "links", "component_id")
    return members.join(materialize(reps), "rep", "left").select(
        "row", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "least", "doc_id").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
    )


def jaccard_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links), n_links.

    Two documents are linked when their sets of ``words``-word shingles share at least ``percent`` of their union. A text with
    fewer words is one shingle; a missing or empty text has none, is linked with nothing and is its own component. A missing
    doc_id is linked with nothing and has no component. Rows with one doc_id are one document: they are in one component, and
    repeated rows, all returned, count once in n_links. Where such rows have different sets, n_links is that of the row's own
    set, and counts a document once for each of its sets that is linked.

    Rows are numbered once in a stored table, and all goes by these numbers, whatever the doc_ids. Equal sets are one class,
    which its smallest row stands for; links are looked for between classes only and copies follow their class (n_links counts
    their documents). Sums that are joined back are stored first: the join then reads both sides from plain shuffles, and a
    class or component with a large part of all rows can be split. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    return _groups(materialize(rows), words, percent).drop("row")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all columns, that stand for their group: those with its smallest (doc_id, row number).

    Groups are made of rows, whatever their doc_ids: rows of one doc_id whose texts are not linked all stay. Of the rows of a
    group that have no doc_id one stays as well. A missing or empty text is linked with nothing and stays.
    """
    number = "row"
    while number.lower() in {c.lower() for c in docs.columns}:
        number += "_"
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()))
    row = F.col(number)
    groups = materialize(_groups(numbered.select(row.alias("row"), row.alias("doc_id"), "text"), words, percent).select("row", "component_id"))
    ids = numbered.select(row.alias("row"), "doc_id")
    first = groups.join(ids, "row").groupBy("component_id", F.col("doc_id").isNull()).agg(F.min(F.struct("doc_id", "row"))["row"].alias("row"))
    dropped = materialize(groups.select("row").join(first.select("row"), "row", "left_anti")).withColumnRenamed("row", number)
    told = _looked_for(numbered, dropped, number)
    mistaken = materialize(told.filter("__likely").select(number).join(dropped, number, "left_anti"))
    spared = told.filter("__likely").join(whole_if_small(mistaken), number, "left_semi")
    return told.filter("NOT __likely").unionByName(spared).drop(number, "__likely")
