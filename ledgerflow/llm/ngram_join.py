"""N-gram Jaccard join: sets of word n-grams, linked where their Jaccard similarity reaches a threshold.

Two steps, neither of which loses a link:

1. *Where to look.* Two sets of sizes a <= b with similarity >= t differ in at most
   (a + b)(1 - t)/(1 + t) elements, call it d. Hash space is cut into m > d ranges, so at least m - d ranges hold the same
   elements in both. Each set gives a signature for each range but those with the fewest uncommon n-grams, of which it may leave out
   (m - d - 1)/2: both sets together cannot leave out all that agree, whichever they are. What is common comes from counts over all data;
   the list is bounded, and what it lacks costs time, not links. Sets that share a signature meet.
   Signatures of unlike sets seldom agree, however frequent single n-grams are. Each task keeps one row per signature
   (the others become links in its forest), so a signature that a third of all rows share
   reaches the shuffle once per task, not once per row.
2. *Prefix-tree join.* The connected groups of step 1 are joined exactly: n-grams have one global
   order (rarest first by the counts over all data, then by hash), the ordered sets go into a path-compressed trie, and one walk
   carries every query's overlap down the tree, sharing what prefixes share, and cuts a subtree for the queries
   whose overlap plus remaining length cannot reach the threshold. Groups above
   a bound are cut into blocks, and each pair of blocks is a task of its own.

Links inside a group leave as a forest, not as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerflow.llm.common import CHUNK_BYTES, Workspace, by_bytes, id_text, mix, spread, string_buffer
from ledgerflow.llm.components import connected_components, forest

#: Words are runs of bytes outside [\x20\x09-\x0D], with A-Z lower-cased (fixed by the contract).
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0x9FB21C651E98DF25)
#: Signatures a task holds before it passes them on, and the members and n-grams of a block of a group.
HELD_SIGNATURES = 400_000
BLOCK_SETS, BLOCK_GRAMS = 4096, 2_000_000
#: Ranges are 1/SLACK more than the bound asks for, so that nearly empty ones can be left out.
SLACK = 4
#: N-grams that one count of a task takes in, and those that a list of common ones holds at most (2 MB).
COUNTED_GRAMS, COMMON_GRAMS = 1_000_000, 1 << 18


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _STEP, np.uint64)
    p[0] = 1
    return np.cumprod(p)


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, row each word is in). Works through ``raw`` in blocks cut at white space."""
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    begin, n = 0, len(raw)
    starts = ends[:-1]
    while begin < n:
        stop = min(n, begin + CHUNK_BYTES // 2)
        if stop < n:  # on to the end of the word: the next white space or row
            edge = np.searchsorted(starts, stop)
            row = int(starts[edge]) if edge < len(starts) else n
            while stop < row:
                gap = _SPACE[raw[stop : min(row, stop + CHUNK_BYTES)]]
                if gap.any():
                    stop += int(gap.argmax())
                    break
                stop += len(gap)
        part = raw[begin:stop]
        solid = ~_SPACE[part]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        cuts = starts[(starts >= begin) & (starts < stop)] - begin
        first[cuts] = solid[cuts]
        at = np.flatnonzero(first)
        if len(at):
            place = np.flatnonzero(solid)
            word = np.cumsum(first)[place] - 1
            offset = place - at[word]
            value = _BYTE[_LOWER[part[place]]] * _powers(int(offset.max()) + 1)[offset]
            edge = np.searchsorted(place, at)
            length = np.diff(np.append(edge, len(place))).astype(np.uint64)
            hashes.append(mix(np.add.reduceat(value, edge) + length * np.uint64(0xD6E8FEB86659FD93)))
            rows.append(np.searchsorted(ends, at + begin, "right") - 1)
        begin = stop
    return np.concatenate(hashes), np.concatenate(rows)


def gram_sets(column: pa.Array, width: int = 3) -> list[np.ndarray]:
    """For every text the sorted distinct hashes of its word n-grams; of fewer words, of the whole sequence; of none, nothing."""
    raw, ends = string_buffer(column)
    words, rows = word_hashes(raw, ends)
    bounds = np.searchsorted(rows, np.arange(len(column) + 1))
    out = []
    scale = [mix(np.uint64(2 * k + 1) * np.uint64(0x9E3779B97F4A7C15) * np.ones(1, np.uint64))[0] | np.uint64(1) for k in range(width)]
    for i in range(len(column)):
        own = words[bounds[i] : bounds[i + 1]]
        k = min(width, len(own))
        if not k:
            out.append(own)
            continue
        total = np.full(len(own) - k + 1, k, np.uint64)
        for j in range(k):
            total = total + mix(own[j : len(own) - k + 1 + j] ^ scale[j]) * scale[j]
        out.append(np.unique(mix(total)))
    return out


def size_classes(threshold: float, largest: int) -> np.ndarray:
    """Lower ends of the size classes; unlike sets below the first one can't reach the threshold."""
    ends = [max(1, int(np.ceil(threshold / (1 - threshold) - 1e-9)))]
    while ends[-1] <= largest:
        ends.append(int(ends[-1] * max(1.5, 1 / threshold)) + 1)
    return np.array(ends)


def signatures(grams: np.ndarray, threshold: float, classes: np.ndarray, rare: np.ndarray | None = None) -> np.ndarray:
    """Signatures of one set: two sets that reach the threshold share at least one. ``rare``: running count of the uncommon n-grams."""
    n = len(grams)
    c = int(np.searchsorted(classes, n, "right")) - 1
    digest = mix(np.add.reduce(mix(grams ^ np.uint64(0x51ED270B9F)), keepdims=True) + np.uint64(n))
    if c < 0:
        return digest
    out = []
    most = (1 - threshold) / threshold
    for k in [c] if c == 0 or threshold * n >= classes[c] else [c, c - 1]:
        top = int((classes[k + 1] - 1) * most + 1e-9)
        parts = top + 1 + top // SLACK + 2
        part = ((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        edges = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        sums = np.zeros(parts + 1, np.uint64)
        sums[1:] = np.cumsum(mix(grams + np.uint64(k)))[edges[1:] - 1] * (edges[1:] > 0)
        sig = mix(np.diff(sums) ^ mix(np.arange(parts, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(k)))
        #: A partner differs in at most n * most elements, whichever of the two is larger; in class k - 1 the bound is top as well.
        skip = max(0, (parts - min(int(n * most + 1e-9), top) - 1) // 2)
        out.append(sig[np.argpartition(np.diff(edges if rare is None else rare[edges]), skip)[skip:]] if skip else sig)
    return np.unique(np.concatenate(out))


_BASE = "id long, n long, d0 long, d1 long, sigs array<long>, peers array<long>"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _count_rows(width: int):
    """(n-gram, number of sets) for those that several sets of a run of rows hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            gram, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(_signed(gram[n > 1])), pa.array(n[n > 1])], names=["gram", "n"])

        for whole in batches:
            for batch in by_bytes(whole):
                held += gram_sets(batch.column("text"), width)
                size = sum(map(len, held))
                if size >= COUNTED_GRAMS:
                    yield out()
                    held = []
        if held:
            yield out()

    return run


def common_grams(texts: DataFrame, width: int, most: int = COMMON_GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` n-grams that many sets hold, as sorted hashes with the logarithms of their counts: all with a count of 2**k or more, for the least k that keeps the bound."""
    counts = texts.mapInArrow(_count_rows(width), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n >= 4")
    work = Workspace(texts.sparkSession, "common-grams")
    counts = work.save(counts, "counts")
    levels = sorted(((r.k, r.n) for r in counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, None
    for k, n in levels:
        total += n
        if total > most:
            break
        least = k
    found = counts.where(F.col("n") >= (1 << (62 if least is None else least))).select("gram", F.floor(F.log2("n")).cast("byte").alias("k")).toArrow()
    work.drop(counts)
    gram, level = np.ascontiguousarray(found.column("gram").to_numpy()).view(np.uint64), found.column("k").to_numpy().astype(np.uint8)
    order = np.argsort(gram)
    return gram[order], level[order]


def _uncommon(sets: list[np.ndarray], common: np.ndarray) -> list[np.ndarray | None]:
    """For every set the running count of what ``common`` lacks."""
    if not len(common) or not sets:
        return [None] * len(sets)
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
    through = np.concatenate([[0], np.cumsum(common[at] != flat)])
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    return [through[a : b + 1] - through[a] for a, b in zip(begin[:-1], begin[1:], strict=True)]


def _signature_rows(width: int, threshold: float, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        sizes: list[int] = []
        digests: list[tuple[int, int]] = []
        sigs: list[np.ndarray] = []
        held = 0
        classes = size_classes(threshold, 1000)

        def out() -> pa.RecordBatch:
            nodes = np.array([0 if i is None else i for i in ids], np.int64)
            lengths = np.array([len(s) for s in sigs])
            flat = np.concatenate(sigs) if sigs else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(sigs)), lengths)
            _, first, inverse = np.unique(flat, return_index=True, return_inverse=True)
            head = owner[first][inverse]
            new = np.zeros(len(flat), bool)
            new[first] = True
            a, b = forest(owner[~new], head[~new]) if len(flat) > len(first) else (np.zeros(0, np.int64),) * 2
            peer = np.full(len(sigs), -1)
            peer[a] = b
            kept = np.bincount(owner[new], minlength=len(sigs)) if len(sigs) else np.zeros(0, np.int64)
            d = np.array(digests, np.uint64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(np.array(sizes, np.int64)),
                    pa.array(_signed(d[:, 0].copy())),
                    pa.array(_signed(d[:, 1].copy())),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)), pa.array(_signed(flat[new]))),
                    pa.array([None if p < 0 else [int(nodes[p])] for p in peer], pa.list_(pa.int64())),
                ],
                names=["id", "n", "d0", "d1", "sigs", "peers"],
            )

        for whole in batches:
            for batch in by_bytes(whole):
                found = gram_sets(batch.column("text"), width)
                for doc, grams, rare in zip(batch.column("id").to_pylist(), found, _uncommon(found, common), strict=True):
                    if len(grams) >= classes[-1]:
                        classes = size_classes(threshold, len(grams))
                    ids.append(doc)
                    sizes.append(len(grams))
                    digests.append((int(np.add.reduce(mix(grams ^ np.uint64(0x243F6A8885A308D3)))), int(np.bitwise_xor.reduce(mix(grams ^ np.uint64(0x13198A2E03707344)))) if len(grams) else 0))
                    sigs.append(signatures(grams, threshold, classes, rare) if len(grams) and doc is not None else grams[:0])
                    held += len(sigs[-1]) + 8
                if held >= HELD_SIGNATURES:
                    yield out()
                    ids, sizes, digests, sigs, held = [], [], [], [], 0
        if ids:
            yield out()

    return run


NO_COUNTS = (np.zeros(0, np.uint64), np.zeros(0, np.uint8))


def trie_components(sets: list[np.ndarray], threshold: float, common: tuple[np.ndarray, np.ndarray] = NO_COUNTS) -> np.ndarray:
    """For each set the smallest index among the sets that links reach: an exact prefix-tree self-join.

    N-grams are in one order for all sets of all groups: those not in ``common`` first, then by the logarithm of their count, then by hash.
    The trie is path-compressed: a node is a run of n-grams that all sets below it share. Every set is a query at once.
    ``overlap`` holds what each query shares with the path so far.
    """
    g = len(sets)
    label = np.arange(g)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    distinct, token = np.unique(flat, return_inverse=True)
    count = np.zeros(len(distinct), np.uint8)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], distinct), len(common[0]) - 1)
        count = np.where(common[0][at] == distinct, common[1][at], count)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    token = rank[token]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    ordered = [np.sort(token[begin[i] : begin[i + 1]]) for i in range(g)]
    #: n-gram -> the queries that hold it
    query = np.repeat(np.arange(g), sizes)[np.argsort(token, kind="stable")]
    post = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(count)))])
    keyed = np.concatenate([x + i * len(count) for i, x in enumerate(ordered)])
    line = sorted(range(g), key=lambda i: ordered[i].astype(">u4").tobytes())
    lcp = np.zeros(g + 1, np.int64)
    for k in range(1, g):
        x, y = ordered[line[k - 1]], ordered[line[k]]
        m = min(len(x), len(y))
        differ = np.flatnonzero(x[:m] != y[:m])
        lcp[k] = differ[0] if len(differ) else m
    line_arr = np.array(line)
    line_size = sizes[line_arr]
    up, down = 1 + threshold, threshold
    stack = [(0, g, 0, np.arange(g), np.zeros(g, np.int64))]
    while stack:
        lo, hi, depth, active, overlap = stack.pop()
        below = line_size[lo:hi]
        own = ordered[line[lo]]
        end = int(lcp[lo + 1 : hi].min()) if hi - lo > 1 else len(own)
        run = own[depth:end]
        if len(run):
            starts, stops = post[run], post[run + 1]
            n = stops - starts
            index = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            overlap = overlap + np.bincount(query[index], minlength=g)
            passed = np.searchsorted(keyed, active * len(count) + run[-1], "right") - begin[active]
            best = overlap[active] + np.minimum(sizes[active] - passed, int(below.max()) - end)
            active = active[best * up + 1e-6 >= down * (sizes[active] + int(below.min()))]
        labels = label[line_arr[lo:hi]]
        if not len(active) or (labels == labels[0]).all() and (label[active] == labels[0]).all():
            continue
        for k in range(lo, hi):
            if line_size[k] != end:
                break
            met = active[overlap[active] * up + 1e-6 >= down * (sizes[active] + end)]
            joined = np.unique(label[np.append(met, line[k])])
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
        else:
            k = hi
        while k < hi:
            stop = k + 1
            while stop < hi and lcp[stop] > end:
                stop += 1
            stack.append((k, stop, end, active, overlap))
            k = stop
    return label


def _join_groups(width: int, threshold: float, common: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def out() -> pa.RecordBatch:
            order = np.argsort(ids, kind="stable")
            nodes = np.array(ids, np.int64)[order]
            label = trie_components([sets[i] for i in order], threshold, common)
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["a", "b"])

        for whole in batches:
            for batch in by_bytes(whole):
                grams = gram_sets(batch.column("text"), width)
                for group, i, j, doc, own in zip(*(batch.column(c).to_pylist() for c in ("group", "i", "j", "id")), grams, strict=True):
                    if (group, i, j) != key:
                        if len(ids) > 1:
                            yield out()
                        key, ids, sets = (group, i, j), [], []
                    ids.append(doc)
                    sets.append(own)
        if len(ids) > 1:
            yield out()

    return run


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, threshold: float = 0.9) -> DataFrame:
    """One row per document: id, n_grams (set size), component (smallest id reachable by links, itself included).

    Documents link where |A & B| >= threshold * |A | B| of their sets of distinct ``width``-word shingles.
    Null and empty texts have the empty set and link with nothing. A text of fewer than ``width`` words is one
    shingle. Equal sets link. Rows that repeat an id are one document if their texts are equal, and link through the
    id otherwise. Other columns are ignored; an empty table gives an empty result. Rows with a null id come back unlinked.
    """
    spark: SparkSession = docs.sparkSession
    work = Workspace(spark, "ngram-join")
    texts = id_text(docs, id_col, text_col)
    common = common_grams(spread(texts), width)
    base = work.save(spread(texts).mapInArrow(_signature_rows(width, threshold, common[0]), _BASE), "signatures", **{"parquet.enable.dictionary": "false"})
    share = W.Window.partitionBy("sig").orderBy("id").rowsBetween(W.Window.unboundedPreceding, 0)
    met = base.select("id", F.explode("sigs").alias("sig")).withColumn("first", F.min("id").over(share)).where("first < id").select(F.col("id").alias("a"), F.col("first").alias("b"))
    local = base.select(F.col("id").alias("a"), F.explode("peers").alias("b"))
    groups = work.save(connected_components(work, met.unionByName(local)), "groups")
    #: Equal sets are one class, named by its smallest id.
    member = work.save(base.select("id", "n", "d0", "d1").join(groups, base["id"] == groups["node"]).select("id", "n", "d0", "d1", F.col("component").alias("group")), "members")
    classes = member.groupBy("d0", "d1", "n").agg(F.min("id").alias("class"), F.min("group").alias("group"))
    classes = work.save(classes, "classes")
    blocks = classes.groupBy("group").agg(F.count("*").alias("sets"), F.sum("n").alias("grams")).where("sets > 1").select("group", F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int").alias("k"))
    dealt = classes.join(blocks, "group").withColumn("own", F.pmod(F.xxhash64("class"), F.col("k")).cast("int"))
    pair = F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda x: x != F.col("own")))
    dealt = dealt.select("class", "group", "k", "own", F.explode(pair).alias("other")).select("class", "group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    gathered = texts.where("id is not null").join(dealt.hint("merge"), F.col("id") == F.col("class")).select("group", "i", "j", "id", "text").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    links = gathered.mapInArrow(_join_groups(width, threshold, common), "a long, b long")
    found = connected_components(work, links)
    named = member.join(classes.select("d0", "d1", "class"), ["d0", "d1"]).select("id", "class")
    named = named.join(found, F.col("class") == F.col("node"), "left").groupBy("id").agg(F.min(F.coalesce("component", "class")).alias("component"))
    return base.select("id", F.col("n").alias("n_grams")).join(named, "id", "left").select("id", "n_grams", F.coalesce("component", "id").alias("component"))
