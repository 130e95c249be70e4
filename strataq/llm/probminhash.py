"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is a bag of five-word shingles; the weight of a shingle is how often
it occurs. In ProbMinHash each element sends points at exponential intervals
with its weight as rate; each point falls into one of ``SLOTS`` slots, and each
slot keeps the element of its earliest point. Two documents agree in a slot
with their probability Jaccard similarity

    J(x, y) = sum over shared d of 1 / sum over e of max(x_e / x_d, y_e / y_d).

All elements of a batch advance together, one arrival a round; an element stops
as soon as its next arrival is later than the latest slot of its document, so
work is close to one arrival per shingle plus SLOTS * ln SLOTS per document.

Documents of equal word sequences are one class, found by a 128-bit digest before
anything else; classes are the nodes of what follows. ``BANDS`` bands of ``ROWS``
slots give candidate pairs: each class of a band is paired with the smallest one
there; classes whose pair fails verification are paired once more among
themselves with their smallest. Pairs with clearly too few equal slots are
dropped (an estimate under ``FLOOR`` or ``FINE_FLOOR`` happens to a pair of
similarity 0.8 about once in a hundred thousand), the others verified exactly on
the whole texts, and verified links joined into components.

A class that links with one of a band may still link with another there. So the
bands whose classes then lie in different components (families of texts that
share much, each with many groups) are compared pair by pair, in blocks of about
``BLOCK`` classes spread over tasks; a block is one row, so what is handed on is a
row for each class and a row for each pair of blocks. Pairs are not handed on: a
task tells first a spanning forest of the pairs whose estimate reaches ``SURE``,
which are then verified like the others; of what still lies in different
components, classes with a partner that reaches FLOOR, and then, on ``FINE``
further one-byte slots, FINE_FLOOR, go on into new blocks, and a last pass
verifies in the task itself, the closest pairs first and none that earlier ones
have joined, and tells the links that joined. So every pair of a band ends in one
component or is known to be no link.

Words are maximal runs of letters and digits, lower case. Cases: texts of fewer
than five words are one shingle; null, empty and wordless texts form one class
of their own (equal word sequences). Very long texts are used whole. An id with
several texts counts once for each word sequence. The smallest id of a component
represents it (of its texts there, the one with the smallest hash) and is kept;
rows that repeat id and text count once. Rows without an id are in no group.
Input columns of any name are kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._batches import map_texts, packed, quoted, slices
from .components import components, cut

SHINGLE, SIMILARITY = 5, 0.8
SLOTS, BANDS, ROWS = 64, 16, 4
FLOOR = 0.56
FINE, FINE_FLOOR, SURE, BLOCK = 1024, 0.746, 0.86, 256
BLOCK_CHARS = 4_000_000
WORD = re.compile(r"[^\W_]+")

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finalizer."""
    x = x + M1
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From word lists, sorted by text: number of the text, hash of a distinct shingle, how often it occurs."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for x in words for w in x]
    if not flat:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    codes, unique = pd.factorize(np.array(flat, object))
    hashed = pd.util.hash_array(unique, categorize=False)[codes].astype(np.uint64)
    doc = np.repeat(np.arange(len(words)), sizes)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - first[doc]
    h = mix(np.minimum(sizes[doc], SHINGLE).astype(np.uint64))
    for k in range(SHINGLE):
        at = np.minimum(np.arange(len(flat)) + k, len(flat) - 1)
        h = np.where(place + k < sizes[doc], mix(h ^ hashed[at]), h)
    use = (place <= sizes[doc] - SHINGLE) | (place == 0) & (sizes[doc] < SHINGLE)
    doc, h = doc[use], h[use]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
    return doc[new], h[new], np.diff(np.r_[new, len(h)])


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """n x slots unsigned 32-bit slot values; rows of texts without shingles are 0."""
    best = np.full(n * slots, np.inf)
    who = np.zeros(n * slots, np.uint64)
    at = np.zeros(len(doc))
    state = element.copy()
    rate = 1.0 / weight
    while len(doc):
        state = mix(state)
        at = at - np.log(uniform(state)) * rate
        state = mix(state)
        slot = doc * slots + (state % np.uint64(slots)).astype(np.int64)
        # The earliest point of each slot in this round, then against what the slot holds.
        early = np.flatnonzero(at < best[slot])
        order = early[np.lexsort((element[early], at[early], slot[early]))]
        lead = order[np.r_[True, slot[order][1:] != slot[order][:-1]]] if len(order) else order
        best[slot[lead]], who[slot[lead]] = at[lead], element[lead]
        latest = best.reshape(n, slots).max(1)
        go = at < latest[doc]
        doc, element, at, state, rate = doc[go], element[go], at[go], state[go], rate[go]
    return (mix(who) >> np.uint64(32)).astype(np.uint32).reshape(n, slots)


def probability_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J of two weighted sets (sorted elements, weights); 0 if either is empty."""
    if not len(x[0]) or not len(y[0]):
        return 0.0
    both, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    a, b = x[1][i].astype(float), y[1][j].astype(float)
    only_x, only_y = float(x[1].sum() - a.sum()), float(y[1].sum() - b.sum())
    ratio = a / b
    kinds, which = np.unique(ratio, return_inverse=True)
    sum_a, sum_b = np.bincount(which, a), np.bincount(which, b)
    # max(x_e / x_d, y_e / y_d) is x_e / x_d where x_e / y_e >= x_d / y_d.
    above = np.cumsum(sum_a[::-1])[::-1]
    below = np.cumsum(sum_b) - sum_b
    return float((1.0 / ((only_x + above[which]) / a + (only_y + below[which]) / b)).sum())


def similarities(left: list[str], right: list[str]) -> np.ndarray:
    sides = []
    for texts in (left, right):
        names = {t: k for k, t in enumerate(dict.fromkeys(texts))}  # the text of a class is often there many times
        doc, element, weight = shingles([words_of(t) for t in names])
        edge = np.searchsorted(doc, np.arange(len(names) + 1))
        sets = [(element[a:b], weight[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        sides.append([sets[names[t]] for t in texts])
    return np.array([probability_jaccard(x, y) for x, y in zip(*sides, strict=True)])


SKETCH = T.StructType([T.StructField("words", T.BinaryType()), T.StructField("slots", T.BinaryType())])


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, words (digest of the word sequence), slots (SLOTS x 4 bytes; null without shingles)."""

    def run(texts: list[str]) -> list:
        words = [words_of(t) for t in texts]
        digests = [hashlib.blake2b(" ".join(w).encode("utf-8", "replace"), digest_size=16).digest() for w in words]
        doc, element, weight = shingles(words)
        rows = signatures(doc, element, weight, len(texts)).astype("<u4")
        has = np.bincount(doc, minlength=len(texts)) > 0
        return [digests, [r.tobytes() if h else None for r, h in zip(rows, has, strict=True)]]

    return map_texts(docs, id_col, text_col, SKETCH, lambda: run)


def fine_slots(texts: DataFrame) -> DataFrame:
    """id and slots (the low bytes of FINE slots) of ``texts`` (id, text)."""

    def run(texts: list[str]) -> list:
        doc, element, weight = shingles([words_of(t) for t in texts])
        return [[r.tobytes() for r in signatures(doc, element, weight, len(texts), FINE).astype(np.uint8)]]

    return map_texts(texts, "id", "text", T.StructType([T.StructField("slots", T.BinaryType())]), lambda: run)


def blocks_of(rows: DataFrame) -> DataFrame:
    """``rows`` (band, id, root, n, top, ...), n the rows of the band and top the root that most of them have, as blocks: (band, i, j, own, members), a row for each pair (i, j) of blocks that block own is in.

    Rows of the top root need no comparison with each other: their blocks meet
    those of the other rows only. So a band costs the rows of its top root times
    the blocks of the others, not the square of all. A row of a block holds all of
    its members, so rows of single classes are never multiplied. Blocks hold about
    BLOCK rows, and fewer where their texts reach BLOCK_CHARS.
    """
    rows = cut(rows)
    chars = F.length("text").cast("long") if "text" in rows.columns else F.lit(0).cast("long")
    main = F.col("root") == F.col("top")
    sizes = rows.groupBy("band").agg(F.sum((~main).cast("int")).alias("others"), F.sum(chars).alias("chars"), F.sum(F.when(main, 0).otherwise(chars)).alias("other_chars"))
    sized = rows.join(cut(sizes), "band")
    blocks = lambda n, c: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(c) / BLOCK_CHARS)).cast("int")
    place = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    sized = sized.withColumns({"mains": F.col("n") - F.col("others"), "main_chars": F.col("chars") - F.col("other_chars")})
    sized = sized.withColumns({"few": blocks("others", "other_chars"), "many": blocks("mains", "main_chars")})
    few, many, small = F.col("few"), F.col("many"), (F.col("n") <= BLOCK) & (F.col("chars") <= BLOCK_CHARS)
    own = F.when(small, 0).when(main, few + place(many)).otherwise(place(few))
    partners = F.when(small, 1).when(main, few).otherwise(few + many)
    content = F.struct("id", *(c for c in rows.columns if c not in ("band", "id", "n", "top")))
    packs = sized.groupBy("band", own.alias("own"), partners.alias("partners")).agg(F.sort_array(F.collect_list(content)).alias("members"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("partners") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    return packs.withColumn("pair", F.explode(pairs)).select("band", "pair.i", "pair.j", "own", "members")


def unpacked(batch: pa.RecordBatch) -> pa.Table:
    """The members of rows of ``blocks_of``, a row each, with band, i, j and own."""
    members = batch.column("members")
    sizes = members.value_lengths().to_numpy(zero_copy_only=False)
    inner = members.flatten()
    columns = {f.name: inner.field(k) for k, f in enumerate(inner.type)}
    return pa.table(columns | {c: pa.array(np.repeat(batch.column(c).to_numpy(), sizes)) for c in ("band", "i", "j", "own")})


def compared(rows: DataFrame, out: T.StructType, compare) -> DataFrame:
    """``compare(table)``, an iterator of batches, of the members of each pair of blocks (band, i, j) of ``rows``, which come from blocks_of; a task holds one pair at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the blocks of a pair that may not yet be whole
        last = None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                key = tuple(row.column(c)[0].as_py() for c in ("band", "i", "j"))
                if held and key != last:
                    yield from compare(pa.concat_tables(held))
                    held = []
                held.append(unpacked(row))
                last = key
        if held:
            yield from compare(pa.concat_tables(held))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j", "own").mapInArrow(run, out)


class Block:
    """Classes of one pair of blocks: their slots, and the sets that they form so far."""

    def __init__(self, block: pa.Table) -> None:
        self.ids, self.own = block.column("id").to_pylist(), block.column("own").to_numpy()
        self.sets = np.unique(np.array(block.column("root").to_pylist(), object), return_inverse=True)[1]
        drawn = b"".join(block.column("slots").to_pylist())
        self.slots = np.frombuffer(drawn, "<u4" if len(drawn) == len(self.ids) * SLOTS * 4 else np.uint8).reshape(len(self.ids), -1)
        self.crossing = block.column("i")[0].as_py() != block.column("j")[0].as_py()

    def near(self, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Later classes in other sets that agree with k in ``least`` of the slots or more, and in how many. Pairs of one block count where it meets itself."""
        other = np.flatnonzero((self.sets[k + 1 :] != self.sets[k]) & ((self.own[k + 1 :] != self.own[k]) | (not self.crossing))) + k + 1
        equal = np.count_nonzero(self.slots[other] == self.slots[k], axis=1)
        close = equal >= int(least * self.slots.shape[1])
        return other[close], equal[close]

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were in different sets; they are in one now."""
        if self.sets[a] == self.sets[b]:
            return False
        self.sets[self.sets == self.sets[b]] = self.sets[a]
        return True

    def edges(self, joined: list[tuple[int, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if joined:
            ends = [sorted((self.ids[a], self.ids[b])) for a, b in joined]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*ends, strict=True), schema, strict=True)], schema=schema)


EDGE = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])


def sure_forest(rows: DataFrame) -> DataFrame:
    """Edges (a, b) that span the pairs of a band with different roots and an estimate of SURE or more, from blocks whose members have slots."""
    schema = to_arrow_schema(EDGE)

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        block = Block(table)
        joined = [(k, o) for k in range(len(block.ids) - 1) for o in block.near(k, SURE)[0].tolist() if block.join(k, o)]
        yield from block.edges(joined, schema)

    return compared(rows, EDGE, compare).distinct()


def undecided(rows: DataFrame, least: float) -> DataFrame:
    """(band, id) of the members of blocks that have a partner with another root and an estimate of ``least`` or more in their band."""
    schema = T.StructType([T.StructField("band", T.LongType()), T.StructField("id", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        block, found = Block(table), set()
        for k in range(len(block.ids) - 1):
            near = block.near(k, least)[0].tolist()
            found.update(near, [k] if near else [])
        if found:
            yield from table.select(arrow.names).take(pa.array(sorted(found))).cast(arrow).to_batches()

    return cut(compared(rows, schema, compare).distinct())


def verified_within(rows: DataFrame) -> DataFrame:
    """Links (a, b) that join all classes of a pair of blocks which links of similarity SIMILARITY join, from blocks whose members have slots and text."""
    schema = to_arrow_schema(EDGE)

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        block, texts = Block(table), table.column("text").to_pylist()
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def content(k: int) -> tuple[np.ndarray, np.ndarray]:
            if k not in held:
                held[k] = shingles([words_of(texts[k])])[1:]
            return held[k]

        # The closest pairs first: what they join need not be looked at again.
        near = [(k, *block.near(k, FINE_FLOOR)) for k in range(len(block.ids) - 1)]
        left = np.repeat([k for k, _, _ in near], [len(o) for _, o, _ in near])
        right, equal = (np.concatenate([x[c] for x in near]) if near else np.empty(0, int) for c in (1, 2))
        joined = []
        for k in np.argsort(-equal, kind="stable").tolist():
            a, b = int(left[k]), int(right[k])
            if block.sets[a] != block.sets[b] and probability_jaccard(content(a), content(b)) >= SIMILARITY - 1e-9:
                block.join(a, b)
                joined.append((a, b))
        yield from block.edges(joined, schema)

    return compared(rows, EDGE, compare).distinct()


def equal_slots(a: F.Column, b: F.Column) -> F.Column:
    """How many of the SLOTS four-byte slots agree."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(SLOTS - 1)), F.lit(0), lambda s, k: s + (F.substring(a, k * 4 + 1, F.lit(4)) == F.substring(b, k * 4 + 1, F.lit(4))).cast("int"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``ok``: whether the exact similarity of the whole texts reaches SIMILARITY."""
    named = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
    joined = pairs.select("a", "b").join(named("a"), "a").join(named("b"), "b").select("a", "b", "text_a", "text_b")
    types = {f.name: f for f in joined.schema.fields}
    schema = T.StructType([types["a"], types["b"], T.StructField("ok", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for a, b in slices([x + y for x, y in zip(left, right, strict=True)]):
                ok = similarities(left[a:b], right[a:b]) >= SIMILARITY - 1e-9
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(ok.tolist(), pa.bool_())], names=["a", "b", "ok"])

    return joined.mapInArrow(run, schema)


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, class_id, group_id and kept, one row per distinct id and word sequence."""
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    keyed = docs.where(F.col(quoted(id_col)).isNotNull()).select(F.struct(F.col(quoted(id_col)).alias("id"), F.xxhash64(text).alias("text_hash")).alias("key"), text.alias("text"))
    drawn = cut(sketches(keyed, "key", "text"))
    # Tables that a hot key is joined to are cut, so that the optimizer can split the join.
    low = cut(drawn.groupBy("words").agg(F.min("key").alias("first"), F.min("slots").alias("slots")))
    classes = low.where(F.col("slots").isNotNull()).select(F.col("words").alias("id"), "slots")
    band = lambda k: F.xxhash64(F.lit(k), F.substring("slots", k * ROWS * 4 + 1, ROWS * 4))
    banded = classes.select("id", F.explode(F.array(*(band(k) for k in range(BANDS)))).alias("band"))
    shared = cut(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band"))
    banded = cut(banded.join(shared, "band", "left_semi"))
    # The texts of classes that share a band, read once for all that follows.
    firsts = low.join(banded.select("id").distinct(), F.col("words") == F.col("id"), "left_semi").select(F.col("words").alias("id"), F.col("first").alias("key"))
    texts = cut(keyed.join(firsts, "key").select("id", "text").dropDuplicates(["id"]))

    def starred(rows: DataFrame) -> DataFrame:
        """(band, a, b): each class with the smallest of its band."""
        least = rows.groupBy("band").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        return rows.join(least, "band").where(F.col("id") > F.col("a")).select("band", "a", F.col("id").alias("b"))

    def linked(pairs: DataFrame) -> DataFrame:
        """The links among distinct pairs (a, b); pairs far from SIMILARITY by their slots are not read."""
        slots = lambda c: classes.select(F.col("id").alias(c), F.col("slots").alias(f"slots_{c}"))
        close = pairs.join(slots("b"), "b").join(slots("a"), "a").where(equal_slots(F.col("slots_a"), F.col("slots_b")) >= int(FLOOR * SLOTS)).select("a", "b")
        return cut(verified(cut(close), texts).where("ok").select("a", "b"))

    def apart(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """``rows`` (band, id) of the bands that hold different roots, with root, n, the rows of the band, and top, the root that most of them have."""
        rows = rows.join(roots, F.col("id") == F.col("node"), "left").select("band", "id", F.coalesce("root", "id").alias("root"))
        sizes = rows.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
        bands = sizes.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots")
        return cut(rows.join(cut(bands), "band"))

    first = cut(starred(banded))
    links = linked(first.select("a", "b").distinct())
    left = first.join(links, ["a", "b"], "left_anti").select("band", F.col("b").alias("id"))
    again = cut(starred(left))
    second = again.join(links, ["a", "b"], "left_anti")
    links = cut(links.unionByName(linked(second.select("a", "b").distinct())).distinct())
    roots = components(links)
    last = apart(banded, roots)
    if not last.isEmpty():
        more = linked(sure_forest(blocks_of(last.join(classes, "id"))))
        links = cut(links.unionByName(more).distinct())
        roots = components(links)
        rough = undecided(blocks_of(apart(last.select("band", "id"), roots).join(classes, "id")), FLOOR)
        fine = cut(fine_slots(texts.join(rough.select("id").distinct(), "id", "left_semi")))
        close = undecided(blocks_of(apart(rough, roots).join(fine, "id")), FINE_FLOOR)
        more = cut(verified_within(blocks_of(apart(close, roots).join(fine, "id").join(texts, "id"))))
        if not more.isEmpty():
            roots = components(links.unionByName(more).distinct())
    member = drawn.groupBy("words", "key.id").agg(F.min("key.text_hash").alias("text_hash"))
    member = member.join(low.select("words", F.col("first.id").alias("class_id")), "words").join(roots, F.col("words") == F.col("node"), "left").withColumn("root", F.coalesce("root", "words")).drop("node")
    heads = cut(low.join(roots, F.col("words") == F.col("node"), "left").groupBy(F.coalesce("root", "words").alias("root")).agg(F.min("first").alias("head")))
    out = member.join(heads, "root")
    return out.select("id", "text_hash", "class_id", F.col("head.id").alias("group_id"), ((F.col("id") == F.col("head.id")) & (F.col("text_hash") == F.col("head.text_hash"))).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct id (and word sequence, should an id have several): id, class_id (smallest id of the equal word sequence), group_id (smallest id of the component), kept."""
    return grouped(docs, id_col, text_col).select(F.col("id").alias(id_col), "class_id", "group_id", "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that represent their group, once each; rows without an id stay."""
    kept = grouped(docs, id_col, text_col).where("kept").select("id", "text_hash")
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    stay = packed(docs, id=F.col(quoted(id_col)), text_hash=F.xxhash64(text)).join(kept, ["id", "text_hash"], "left_semi").dropDuplicates(["id", "text_hash"])
    return stay.select("row.*").unionByName(docs.where(F.col(quoted(id_col)).isNull()))
