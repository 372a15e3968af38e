"""Documents joined by the Jaccard similarity of their sets of word n-grams, exactly.

Equal sets are one node. Shingles are put in order, rarest first, so that two similar sets must
share one of the first few of each (their prefix). How often a shingle comes is counted over
all texts: tasks send sorted hashes, Golomb-coded, to the owners of their ranges, and owners
return bitmaps of where in the hash space shingles come at least so often. The bitmaps have a
bounded size; a full one makes the order poorer, never the result. Shingles that come once
are not sent on.

Relations between sets are used twice:
- In the list of a shingle, entries lie in blocks of one set size, by position. Two sets that
  share the shingle at positions i and j can only be similar if both positions are small
  enough for their two sizes, so a block is skipped by its first entry, and what passes
  of two blocks passes altogether: it is linked as a tree and not as pairs.
- Candidates that hang together are compared in full. The overlaps of a set with all others
  are derived from those of the most similar set done before, by the lists of the shingles
  that only one of the two has.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tierscope.llm import exact
from tierscope.llm.common import chunks, filled, map_batches, per_text, saved, struct_array, text_or_empty
from tierscope.llm.components import components

SEED = 42
STEP = np.uint64(0x9E3779B97F4A7C15)  # odd
SLOT_BITS = 26  # a bitmap has 2**26 bits, 8 MB, at most
OFTEN = (2, 16, 256, 4096)  # how often a shingle comes; a bitmap for each
KEPT_BITS = 40  # of a hash that is counted
SENT_AT_ONCE = 1 << 20  # hashes that a task sorts and sends together
OWNED = 1 << 22  # hashes of an owner
TILE_ROWS, TILE_SHINGLES = 1024, 1 << 20  # sets compared together, at most so many shingles in a row
SPREAD, LEAST_TILE = 12, 128  # tiles of a group too small for that, and sets of these
COUNTED = pa.schema([
    ("owner", pa.int32()), ("n", pa.int32()), ("low_bits", pa.int32()), ("first", pa.binary()),
    ("high", pa.binary()), ("low", pa.binary()), ("again", pa.binary()), ("times", pa.binary()),
])


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles; of all words if there are fewer."""
    lower = pc.ascii_lower(pc.ascii_trim_whitespace(texts))
    lists = pc.ascii_split_whitespace(lower)
    coded = lists.flatten().dictionary_encode()
    digest = xxhash.xxh64_intdigest
    known = np.array([digest(w, SEED) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    word = known[coded.indices.to_numpy(zero_copy_only=False)]
    starts = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
    total = word[: max(len(word) - words + 1, 0)].copy()
    for i in range(1, words):
        total = total * STEP + word[i : i + len(total)]
    total = mixed(total)
    empty = pc.equal(lower, "").to_pylist()
    sets = []
    for start, end, none in zip(starts, starts[1:], empty):
        if none:
            sets.append(np.zeros(0, np.uint64))
        elif end - start >= words:
            sets.append(np.unique(total[start : end - words + 1]))
        else:
            whole = word[start : start + 1]
            for i in range(start + 1, end):
                whole = whole * STEP + word[i : i + 1]
            sets.append(mixed(whole))
    return sets


def mixed(hashes: np.ndarray) -> np.ndarray:
    out = hashes ^ (hashes >> np.uint64(31))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def digest_of(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes(), SEED)


def prefix_length(n: int, percent: int) -> int:
    """So many of the first shingles of a set of n; a similar set has one of them in its own."""
    return n - -(-percent * n // 100) + 1


def least_common(a, b, percent: int):
    """Shingles that sets of sizes a and b must share to be similar."""
    return -(-percent * (a + b) // (100 + percent))


def distinct_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """The sets of the texts in the first column, each once a task, with their digest."""
    seen: set[bytes] = set()
    for batch in batches:
        for part in chunks(filled(batch.column(0))):
            for hashes in shingle_sets(part, words):
                digest = digest_of(hashes)
                if len(hashes) and digest not in seen:
                    seen.add(digest)
                    yield digest, hashes


# ---------------------------------------------------------------- how often shingles come

def often_slots(docs: DataFrame, words: int, owners: int, slot_bits: int) -> DataFrame:
    """Rows (level, word, bits): 64 slots of the bitmap of shingles that come OFTEN[level] times."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def coded() -> pa.RecordBatch:
            every = np.concatenate(held) >> np.uint64(64 - KEPT_BITS)
            values, times = np.unique(every, return_counts=True)
            owner = (values * np.uint64(owners)) >> np.uint64(KEPT_BITS)
            cuts = np.flatnonzero(np.diff(owner)) + 1
            rows = []
            for own, part, n in zip(*(np.split(x, cuts) for x in (owner, values, times))):
                again = np.flatnonzero(n > 1).astype(np.uint32)
                rows.append((
                    int(own[0]), len(part), *exact.golomb_encode(part), again.tobytes(),
                    n[again].astype(np.uint32).tobytes(),
                ))
            return pa.RecordBatch.from_pydict(dict(zip(COUNTED.names, zip(*rows))), COUNTED)

        for _, hashes in distinct_sets(batches, words):
            held.append(hashes)
            size += len(hashes)
            if size >= SENT_AT_ONCE:
                yield coded()
                held, size = [], 0
        if held:
            yield coded()

    def receive(blobs: pa.Table) -> pa.Table:
        values, times = [], []
        for row in blobs.drop_columns("owner").to_pylist():
            *code, again, more = row.values()
            values.append(exact.golomb_decode(*code))
            n = np.ones(len(values[-1]), np.int64)
            n[np.frombuffer(again, np.uint32)] = np.frombuffer(more, np.uint32)
            times.append(n)
        value, which = np.unique(np.concatenate(values), return_inverse=True)
        total = np.bincount(which, np.concatenate(times))
        out = {"level": [], "word": [], "bits": []}
        for level, least in enumerate(OFTEN):
            slots = np.unique(value[total >= least] >> np.uint64(KEPT_BITS - slot_bits))
            held, first = np.unique(slots >> np.uint64(6), return_index=True)
            one = np.uint64(1) << (slots & np.uint64(63))
            out["level"].append(np.full(len(held), level, np.int32))
            out["word"].append(held.astype(np.int64))
            out["bits"].append((np.bitwise_or.reduceat(one, first) if len(slots) else one).view(np.int64))
        return pa.table({k: np.concatenate(v) for k, v in out.items()})

    blobs = map_batches(docs.select("text"), send, from_arrow_schema(COUNTED))
    found = blobs.groupBy("owner").applyInArrow(receive, "level int, word bigint, bits bigint")
    return found.groupBy("level", "word").agg(F.bit_or("bits").alias("bits"))


def bitmaps(slots: DataFrame, slot_bits: int) -> np.ndarray:
    """The bitmaps of all levels, of a bounded size."""
    out = np.zeros((len(OFTEN), 1 << (slot_bits - 6)), np.uint64)
    table = slots.toArrow()
    out[table["level"].to_numpy(), table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return out


def commonness(hashes: np.ndarray, maps: np.ndarray, slot_bits: int) -> np.ndarray:
    """The number of levels that each hash reaches."""
    slot = hashes >> np.uint64(64 - slot_bits)
    word, place = (slot >> np.uint64(6)).astype(np.int64), slot & np.uint64(63)
    return sum(((m[word] >> place) & np.uint64(1)).astype(np.uint8) for m in maps)


# ---------------------------------------------------------------- candidates

def postings(docs: DataFrame, words: int, percent: int, maps, slot_bits: int) -> DataFrame:
    """Entries of the lists: the shingles of each set's prefix that other sets may have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, rows, size = maps.value, [], 0

        def packed() -> pa.RecordBatch:
            digests, sizes, tokens, places = zip(*rows)
            counts = list(map(len, tokens))
            nodes = pa.array(digests, pa.binary()).take(pa.array(np.repeat(np.arange(len(rows)), counts)))
            return pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(tokens).view(np.int64)),
                pa.array(np.repeat(np.array(sizes, np.int32), counts)),
                pa.array(np.concatenate(places).astype(np.int32)), nodes,
            ], names=["token", "n", "place", "node"])

        for digest, hashes in distinct_sets(batches, words):
            level = commonness(hashes, levels, slot_bits)
            first = np.argsort(level, kind="stable")[: prefix_length(len(hashes), percent)]
            shared = np.flatnonzero(level[first])
            if len(shared):
                rows.append((digest, len(hashes), hashes[first[shared]], shared))
                size += len(shared)
            if size > 1 << 16:
                yield packed()
                rows, size = [], 0
        if rows:
            yield packed()

    return map_batches(docs.select("text"), run, "token bigint, n int, place int, node binary")


def in_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows sorted by keys, whole groups at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows - 1, bool)
        for key in keys:
            column = batch[key]
            changed |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(changed)[-1]) + 1 if changed.any() else 0
        same = held and all(held[-1][k][-1] == batch[k][0] for k in keys)
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def candidates(lists: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the same nodes as all pairs do that a list leaves possible.

    Entries of one size and position are one class; a task holds the classes of a list, not
    its entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[pa.Array, pa.Array]] = []

        def classes() -> Iterator[pa.RecordBatch]:
            """The first entry of each class; links of the others to it are noted."""
            held = None  # the last class of the batch before
            for batch in batches:
                if not batch.num_rows:
                    continue
                if held is not None:
                    batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                key = np.stack([batch[c].to_numpy() for c in ("token", "n", "place")])
                new = np.append(True, (key[:, 1:] != key[:, :-1]).any(0))
                first = np.flatnonzero(new)
                to = np.repeat(first, np.diff(np.append(first, len(new))))
                more = np.flatnonzero(~new)
                nodes = batch["node"]
                links.append((nodes.take(pa.array(more)), nodes.take(pa.array(to[more]))))
                kept = batch.take(pa.array(first if held is None else first[1:]))
                held = batch.slice(int(first[-1]), 1)
                yield kept

        for lists_ in in_groups(classes(), ["token"]):
            lists_ = lists_.combine_chunks()
            a, b = linked_blocks(*(lists_[c].to_numpy() for c in ("token", "n", "place")), percent)
            nodes = lists_["node"].combine_chunks()
            links.append((nodes.take(pa.array(a)), nodes.take(pa.array(b))))
            yield from _edges(links)
            links.clear()
        yield from _edges(links)

    ordered = lists.repartition("token").sortWithinPartitions("token", "n", "place", "node")
    found = map_batches(ordered, run, "a binary, b binary")
    return found.where("a <> b").distinct()


def _edges(links: list[tuple[pa.Array, pa.Array]]) -> Iterator[pa.RecordBatch]:
    for a, b in links:
        if len(a):
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])


def linked_blocks(token, n, place, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between entries of lists sorted by token, n, place, in blocks of one token and n."""
    first = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (n[1:] != n[:-1])))
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(n))))
    token, size, least = token[first], n[first].astype(np.int64), place[first]
    reach = np.full(len(first), -1, np.int64)  # positions that pass with some block
    own = size - least_common(size, size, percent)
    reach = np.where(own >= least, own, reach)
    a_links, b_links, at = [], [], np.arange(len(first))
    for shift in range(1, len(first)):
        at = at[at + shift < len(first)]
        other = at + shift
        near = (token[other] == token[at]) & (percent * size[other] <= 100 * size[at])
        at, other = at[near], other[near]  # later blocks are of larger sets still
        if not len(at):
            break
        common = least_common(size[at], size[other], percent)
        here, there = size[at] - common, size[other] - common
        passes = (least[at] <= here) & (least[other] <= there)
        i, j = at[passes], other[passes]
        reach[i] = np.maximum(reach[i], here[passes])
        reach[j] = np.maximum(reach[j], there[passes])
        a_links.append(first[i])
        b_links.append(first[j])
    inside = np.flatnonzero(place <= reach[of])
    inside = inside[inside != first[of[inside]]]
    return np.concatenate([inside, *a_links]), np.concatenate([first[of[inside]], *b_links])


# ---------------------------------------------------------------- answers

def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets.

    A set's overlaps are derived from those of the set before it that it differs from least.
    """
    m = len(sets)
    sizes = np.array(list(map(len, sets)))
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    ids = np.split(number, np.cumsum(sizes)[:-1])
    owner = np.repeat(np.arange(m), sizes)[np.argsort(number, kind="stable")]  # lists of all shingles
    ends = np.cumsum(np.bincount(number))
    starts = np.append(0, ends[:-1])

    def counted(shingles: np.ndarray) -> np.ndarray:
        lengths = ends[shingles] - starts[shingles]
        skip = np.repeat(starts[shingles] - np.cumsum(lengths) + lengths, lengths)
        return np.bincount(owner[skip + np.arange(len(skip))], minlength=m)

    out = np.zeros((m, m), np.int64)
    apart, parent = sizes.copy(), np.full(m, -1)
    mark = np.zeros(len(ends), bool)
    for s in range(m):
        if parent[s] < 0:
            out[s] = counted(ids[s])
        else:
            near = ids[parent[s]]
            mark[ids[s]] = True
            gone = near[~mark[near]]
            mark[ids[s]] = False
            mark[near] = True
            come = ids[s][~mark[ids[s]]]
            mark[near] = False
            out[s] = out[parent[s]] + counted(come) - counted(gone)
        differ = sizes[s] + sizes - 2 * out[s]
        closer = differ < apart
        apart[closer], parent[closer] = differ[closer], s
    return out


def confirm(docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) of similar sets as trees, and rows (a, null, links) of the documents that
    a set's links reach.

    `nodes` has node, root (of the candidates it hangs together with), doc_id, print_ (hash of
    one document), n and copies. Only these documents' sets are shuffled. The sets of a root are
    dealt to tiles, and each pair of tiles is compared.
    """
    slot_bits = min(exact.SLOT_BITS, max(12, nodes.count().bit_length() + 8))
    bitmap = saved(exact.bitmap(nodes, "print_", slot_bits), "candidates-bitmap")
    texts = exact.is_suspect(
        docs.select("text", _print().alias("print_")), "print_", bitmap, slot_bits
    ).where("suspect_").select("text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for digest, hashes in distinct_sets(batches, words):
            yield pa.RecordBatch.from_arrays([
                pa.array([digest], pa.binary()), pa.array([hashes.tobytes()], pa.binary()),
            ], names=["node", "shingles"])

    sizes = nodes.groupBy("root").agg(F.ceil(F.greatest(
        F.count("*") / TILE_ROWS, F.sum("n") / TILE_SHINGLES, F.lit(1),
        F.least(F.lit(SPREAD), F.count("*") / LEAST_TILE),
    )).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    tiles = (
        map_batches(texts, sets, "node binary, shingles binary").dropDuplicates(["node"])
        .join(nodes.select("node", "root", "copies"), "node").join(sizes, "root")
        .withColumn("part", part).withColumn("other", other)
        .select("root", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"),
                "part", "node", "copies", "shingles")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tables in in_groups(batches, ["root", "x", "y"]):
            tables = tables.combine_chunks()
            changed = np.zeros(tables.num_rows, bool)
            changed[0] = True
            for key in ("root", "x", "y"):
                column = tables[key].chunk(0)
                changed[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            cuts = np.append(np.flatnonzero(changed), tables.num_rows)
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield from _answers(tables.slice(start, end - start), percent)

    keys = ["root", "x", "y"]
    ordered = tiles.repartition(*keys).sortWithinPartitions(*keys, "node")
    return map_batches(ordered, run, "a binary, b binary, links bigint")


def _answers(tile: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    held = [np.frombuffer(s, np.uint64) for s in tile["shingles"].to_pylist()]
    part, copies = tile["part"].to_numpy(), tile["copies"].to_numpy()
    sizes = np.array(list(map(len, held)))
    common = overlaps(held)
    similar = 100 * common >= percent * (sizes[:, None] + sizes - common)
    if tile["x"][0] != tile["y"][0]:  # of two tiles only what lies between them
        similar &= part[:, None] != part
    np.fill_diagonal(similar, False)
    links = similar @ copies
    nodes = tile["node"].combine_chunks()
    some = np.flatnonzero(links)
    if len(some):
        i, j = np.nonzero(np.triu(similar))
        root = forest(len(held), i, j)
        moved = np.flatnonzero(root != np.arange(len(root)))
        names = ["a", "b", "links"]
        yield pa.RecordBatch.from_arrays([
            nodes.take(pa.array(moved)), nodes.take(pa.array(root[moved])),
            pa.nulls(len(moved), pa.int64()),
        ], names=names)
        yield pa.RecordBatch.from_arrays([
            nodes.take(pa.array(some)), pa.nulls(len(some), pa.binary()), pa.array(links[some]),
        ], names=names)


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links u - v."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _print():
    return F.xxhash64("doc_id", text_or_empty())


def joined(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links.

    A document's set: the distinct shingles of `words` words in lower case (A-Z), parted by ASCII
    white space; all words as one if there are fewer. Two documents link when the intersection
    of their sets is at least `percent` percent of the union. component_id is the smallest doc_id
    reachable by links, n_links the number of other documents that a document links with.
    Shingles are compared by 64-bit hashes, sets by 128-bit hashes of these.

    Needs doc_id and text; other columns are ignored. Null, empty and blank texts have no shingle
    and link with nothing: component_id is their own doc_id. Documents with equal sets link.
    Rows that repeat are rows of the result and link with each other. A null doc_id is never the
    smallest unless the component has no other. No documents give no rows.
    """

    def described(texts: pa.Array) -> pa.Array:
        sets = shingle_sets(texts, words)
        return struct_array(
            n=pa.array(list(map(len, sets)), pa.int64()),
            node=pa.array([digest_of(s) if len(s) else None for s in sets], pa.binary()),
        )

    sets = saved(
        docs.select(
            "doc_id", _print().alias("print_"),
            per_text(described, "struct<n:bigint,node:binary>")(F.col("text")).alias("s"),
        ).select("doc_id", "print_", "s.n", "s.node"),
        "sets",
    )
    nodes = saved(
        sets.where("node IS NOT NULL").groupBy("node").agg(
            F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"),
            F.min("print_").alias("print_"),
        ),
        "nodes",
    )
    total = nodes.agg(F.sum("n")).first()[0] or 0
    slot_bits = min(SLOT_BITS, max(12, total.bit_length() + 3))
    slots = often_slots(docs, words, ceil((total + 1) / OWNED), slot_bits)
    maps = docs.sparkSession.sparkContext.broadcast(bitmaps(slots, slot_bits))
    maybe = components(candidates(postings(docs, words, percent, maps, slot_bits), percent))
    tried = saved(nodes.join(maybe, "node").select("node", "root", "print_", "n", "copies"), "maybe")
    answers = saved(confirm(docs, tried, words, percent), "answers")
    roots = components(answers.where("b IS NOT NULL").select("a", "b"))
    links = answers.where("links IS NOT NULL").groupBy("a").agg(F.sum("links").alias("links"))
    rooted = nodes.join(roots, "node", "left").join(
        links.withColumnRenamed("a", "node"), "node", "left"
    ).select(
        "node", "least", F.coalesce("root", "node").alias("root"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(least, "root").select("node", "component_id", "n_links")
    return sets.join(found, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        .alias("component_id"),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
    )
