"""Near-duplicate documents: MinHash with tensored banding, links confirmed on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm import textscan as ts
from siftstone.llm.shared import attach, components, cut, fits

#: Words of a shingle, and the similarity of a link in hundredths.
SHINGLE, PERCENT = 5, 80
#: Each half key joins ROWS minhashes; each of the two collections has HALVES half keys, and
#: a table key is a pair of them, one of each: HALVES**2 tables from 2 * HALVES * ROWS minhashes.
#: A pair of similarity s is missed with probability 1 - (1 - (1 - s**4)**20)**2: 5e-5 at 0.8, 2e-8 at 0.9.
ROWS, HALVES = 4, 20
#: Distinct texts, and shingles of them, that are verified in one task; larger candidate groups go by blocks.
BLOCK, BLOCK_SHINGLES = 3000, 1_500_000


def shingle_sets(words: ts.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and where each row's begin."""
    hashes = ts.word_hashes(words, 0, lower=True)
    counts = words.counts
    at = np.flatnonzero((np.arange(len(words.row)) - words.first[words.row] + size <= counts[words.row]) | ((counts < size)[words.row] & (np.arange(len(words.row)) == words.first[words.row])))
    row = words.row[at]
    sets = ts.ranges(hashes, at, at + np.minimum(size, counts[row]), 4)
    order = np.lexsort((sets, row))
    row, sets = row[order], sets[order]
    new = np.ones(len(sets), bool)
    new[1:] = (sets[1:] != sets[:-1]) | (row[1:] != row[:-1])
    return sets[new], np.searchsorted(row[new], np.arange(len(counts) + 1))


def _signatures(size: int, rows: int, halves: int):
    """doc_id, text_key, n_shingles, a 128-bit digest of the set, and the half keys (none for an empty set)."""

    def scan(batches):
        rng = np.random.default_rng(31)
        scale = rng.integers(0, 2**63, 2 * halves * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        for piece in ts.pieces(batches):
            sets, first = shingle_sets(ts.words(piece.column("text")), size)
            digests = map(pa.array, ts.digests([sets], first))
            filled = np.flatnonzero(first[1:] > first[:-1])
            keys = np.zeros((len(filled), 2 * halves), np.uint64)
            if len(filled):
                mins = np.empty((len(filled), len(scale)), np.uint64)
                for j in range(len(scale)):
                    mins[:, j] = np.minimum.reduceat(sets * scale[j], first[filled])
                for h in range(2 * halves):
                    key = np.full(len(filled), h + 1, np.uint64)
                    for j in range(rows):
                        key = ts.mix(key * np.uint64(0x9E3779B97F4A7C15) + mins[:, h * rows + j])
                    keys[:, h] = key
            bounds = np.zeros(len(piece) + 1, np.int64)
            bounds[1:] = np.cumsum(first[1:] > first[:-1]) * 2 * halves
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text_key"), pa.array(np.diff(first)), *digests, ts.long_list(keys.ravel(), bounds)], ["doc_id", "text_key", "n_shingles", "d1", "d2", "halves"])

    return scan


def _sets(size: int):
    """The row's numbers and its shingle set as bytes."""

    def scan(batches):
        for piece in ts.pieces(batches):
            sets, first = shingle_sets(ts.words(piece.column("text")), size)
            bounds = pa.py_buffer((first * 8).astype(np.int32).tobytes())
            packed = pa.Array.from_buffers(pa.binary(), len(piece), [None, bounds, pa.py_buffer(sets.tobytes())])
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("tasks"), packed], ["doc_id", "tasks", "shingles"])

    return scan


def _slices(start: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of start[w]:start[w + 1] for each w, one after the other."""
    n = start[which + 1] - start[which]
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[which] - (ends - n), n)


def forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect exactly what all links (100 * shared >= percent * union) would connect.

    Sets of similarity s and sizes m <= n share a token among the rarest n - ceil(s * n) + 1
    of each, so candidates come from those tokens alone. By size, each set is counted against all its candidates at
    once through an index of all tokens, and linked once to each group among them.
    """
    n = len(sets)
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, token, uses = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    nth = np.lexsort((token, uses[token], owner))
    token, owner = token[nth], owner[nth]
    first = np.concatenate([[0], np.cumsum(sizes)])
    rare = (np.arange(len(owner)) - first[owner] < sizes[owner] - -(-sizes[owner] * percent // 100) + 1) & (uses[token] > 1)
    shared = uses[token] > 1

    def index(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of each set, and sets of each token."""
        t, o = token[keep], owner[keep]
        by = np.argsort(t, kind="stable")
        return t, np.searchsorted(o, np.arange(n + 1)), o[by], np.searchsorted(t[by], np.arange(len(uses) + 1))

    few, few_at, few_sets, few_start = index(rare)
    all_, all_at, all_sets, all_start = index(shared)
    root, links = np.arange(n), []
    for b in range(1, n):
        mine = few[few_at[b] : few_at[b + 1]]
        near = few_sets[_slices(few_start, mine)]
        near = np.unique(near[near < b])
        near = near[sizes[near] * 100 >= percent * sizes[b]]
        if not len(near):
            continue
        met = np.bincount(all_sets[_slices(all_start, all_[all_at[b] : all_at[b + 1]])], minlength=n)[near]
        near = near[100 * met >= percent * (sizes[near] + sizes[b] - met)]
        for group, at in zip(*np.unique(root[near], return_index=True), strict=True):
            links.append((int(order[near[at]]), int(order[b])))
            root[root == group] = b
        root[b] = b
    return links


def _verify(percent: int):
    """Rows come sorted by task; one task's sets at a time are held."""

    def links(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        found = forest(sets, percent)
        return pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in found], pa.int64()), pa.array([ids[b] for _, b in found], pa.int64())], ["a", "b"])

    def scan(batches):
        now, ids, sets = None, [], []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("root", "block", "chunk")), strict=True)
            for key, doc, packed in zip(keys, batch.column("doc_id").to_pylist(), batch.column("shingles"), strict=True):
                if key != now:
                    if len(ids) > 1:
                        yield links(ids, sets)
                    now, ids, sets = key, [], []
                ids.append(doc)
                sets.append(np.frombuffer(packed.as_buffer(), np.uint64).copy())
        if len(ids) > 1:
            yield links(ids, sets)

    return scan


def _links(keyed: DataFrame, tasks: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b): links among the texts of each task, of (doc_id, text_key, tasks) rows with an array of (root, block, chunk)."""
    sets = attach(keyed, tasks, ["doc_id", "text_key"], "inner").dropDuplicates(["doc_id", "text_key"])
    sets = sets.select("doc_id", "tasks", "text").mapInArrow(_sets(shingle), "doc_id long, tasks array<struct<root:long,block:int,chunk:int>>, shingles binary")
    spread = sets.select("doc_id", F.explode("tasks").alias("t"), "shingles").select("doc_id", "t.*", "shingles")
    return cut(spread.repartition("root", "block", "chunk").sortWithinPartitions("root", "block", "chunk", "doc_id").mapInArrow(_verify(percent), "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS, halves: int = HALVES, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``.

    A text's set holds its distinct ``shingle``-word shingles, A-Z lower-cased (all words as one
    shingle if there are fewer; empty without words). Documents link if
    100 * shared >= ``percent`` * union; component_id is the smallest doc_id that links reach.

    Equal sets count once. Half keys that one text alone holds are dropped before the
    tensor, so tables are formed only for texts that can meet. Texts of a table are joined to
    the smallest (a star, never all pairs) and stars make candidate groups; a group is
    then compared on full sets by a prefix-filtered join inside a task, which yields a spanning forest of its links.
    A group of more than ``block`` texts (or BLOCK_SHINGLES shingles) is compared in blocks first. Texts that are then
    linked to most of their group need no more comparisons with each other: only the others, in chunks of
    that size, meet the blocks. So a large group of copies is sent once, and once more for each chunk of others.

    Empty sets link with nothing. A null doc_id has no component (null) and is kept. Rows with one
    doc_id are one document: their texts share a component, and repeated rows are all kept or
    dropped together. A similarity of just ``percent`` links. Texts of any length are read whole; an empty table gives none.
    Other columns are ignored.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    base = cut(keyed.mapInArrow(_signatures(shingle, rows, halves), "doc_id long, text_key long, n_shingles long, d1 long, d2 long, halves array<long>"))
    texts = base.where("doc_id is not null and n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "text_key")).alias("least"), F.any_value("halves").alias("halves"))
    texts = cut(texts.select("d1", "d2", "n_shingles", "least.doc_id", "least.text_key", "halves"))

    half = texts.select("doc_id", F.posexplode("halves").alias("side", "half")).withColumn("side", (F.col("side") >= halves).cast("int"))
    common = half.groupBy("half").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("half")
    met = half.join(common, "half", "left_semi").groupBy("doc_id").agg(*[F.collect_set(F.when(F.col("side") == s, F.col("half"))).alias(f"side{s}") for s in (0, 1)])
    tables = met.select("doc_id", "side1", F.explode("side0").alias("left")).select("doc_id", "left", F.explode("side1").alias("right")).select("doc_id", F.xxhash64("left", "right").alias("key"))
    tables = cut(tables)
    centres = tables.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key", "a")
    groups = components(tables.join(centres, "key").where("doc_id > a").select("a", F.col("doc_id").alias("b")).distinct())

    held = groups.join(texts.select(F.col("doc_id").alias("node"), "text_key", "n_shingles"), "node")
    parts = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = cut(held.groupBy("root").agg(parts.alias("blocks")))
    held = cut(attach(held, sizes, ["root"], "inner").select(F.col("node").alias("doc_id"), "text_key", "root", "blocks", "n_shingles", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("mine")))
    task = lambda block, chunk: F.struct("root", block.cast("int").alias("block"), chunk.cast("int").alias("chunk"))
    links = _links(keyed, cut(held.select("doc_id", "text_key", F.array(task(F.col("mine"), F.lit(-1))).alias("tasks"))), shingle, percent)
    links_of = components(links)
    large = sizes.where("blocks > 1")
    if large.limit(1).count():
        named = attach(held, cut(large.select("root")), ["root"], "left_semi").join(links_of.select(F.col("node").alias("doc_id"), F.col("root").alias("label")), "doc_id", "left")
        named = cut(named.withColumn("label", F.coalesce("label", "doc_id")))
        most = named.groupBy("root", "label").agg(F.struct(F.count("*").alias("n"), "label", F.sum("n_shingles").alias("s")).alias("c"))
        most = most.groupBy("root").agg(F.max("c").alias("main"), F.sum("c.n").alias("n"), F.sum("c.s").alias("s")).where("n > main.n")
        chunks = F.greatest(F.ceil((F.col("n") - F.col("main.n")) / block), F.ceil((F.col("s") - F.col("main.s")) / BLOCK_SHINGLES)).cast("int")
        most = cut(most.select("root", F.col("main.label").alias("main"), chunks.alias("chunks")))
        named = attach(named, most, ["root"], "inner")
        # every text in its block meets each chunk of others; an other one meets each block, in its chunk
        blocks, chunks = F.sequence(F.lit(0), F.col("blocks") - 1), F.sequence(F.lit(0), F.col("chunks") - 1)
        at = F.transform(chunks, lambda c: task(F.col("mine"), c))
        chunk = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.col("chunks"))
        tasks = F.when(F.col("label") == F.col("main"), at).otherwise(F.array_union(at, F.transform(blocks, lambda b: task(b, chunk))))
        more = _links(keyed, cut(named.select("doc_id", "text_key", tasks.alias("tasks"))), shingle, percent)
        links_of = components(links.union(more))
    links = links_of

    # rows of one doc_id with different texts are one node
    roots = texts.select("d1", "d2", "n_shingles", F.col("doc_id").alias("first"))
    spread = base.where("doc_id is not null and n_shingles > 0").join(roots, ["d1", "d2", "n_shingles"])
    again = cut(spread.groupBy("doc_id").agg(F.min("first").alias("a"), F.max("first").alias("b")))
    twice = again.where("a < b")
    if twice.limit(1).count():
        joined = spread.join(twice.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).where("a <> b").distinct()
        links = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")).union(joined))
    label = again.join(links.withColumnRenamed("node", "a"), "a", "left").select("doc_id", F.coalesce("root", "a").alias("label"))
    out = base.select("doc_id", "n_shingles").join(label, "doc_id", "left")
    component = F.coalesce("label", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each group; of rows alike in id and text one stays.

    Of rows with one doc_id and different texts all stay or go together. Rows with a null doc_id stay.
    """
    found = near_duplicates(docs, shingle, percent)
    gone = cut(found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct())
    small = F.broadcast(gone) if fits(gone) else gone
    return docs.join(small, docs["doc_id"] == F.col("_gone"), "left_anti")
