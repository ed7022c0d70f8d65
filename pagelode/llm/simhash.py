"""SimHash near-duplicates: fingerprints joined with themselves by walking a binary trie in pairs of nodes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm.common import Workspace, arrow_groups, arrow_map, bounds, byte_slices, named, schema_of, text_column
from pagelode.llm.components import Forest, connected_components

SHINGLE = 3
SEED = 42
ERRORS = 2
BITS = 64
#: Distinct fingerprints under a node at which the trie is dealt to tasks.
NODE_SIZE = 32768
#: Pairs of nodes that a task walks at a time, and the product of sizes at which a pair is compared outright.
WALKED, SMALL = 1 << 19, 16


def fingerprints(texts: list[bytes], width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The SimHash of each text: a bit is set if it is set in over half of the hashes of the text's word shingles."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.lower().split()  # of bytes: A-Z alone, and the six ASCII white-space characters
        if not words:
            continue
        line = b" ".join(words)
        if len(words) <= width:
            found = [digest(line, seed)]
        else:
            gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
            starts = [0, *(gaps + 1).tolist()]
            ends = [*gaps.tolist(), len(line)]
            found = [digest(line[a:b], seed) for a, b in zip(starts, ends[width - 1 :], strict=False)]
        hashes += found
        counts[i] = len(found)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        edges = bounds(counts[some])
        sums = np.zeros((len(some), BITS), np.int64)
        values = np.array(hashes, "<u8")
        step = 1 << 14
        for a in range(0, len(values), step):  # blocks of shingles, cut within texts too
            bits = np.unpackbits(values[a : a + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first = int(np.searchsorted(edges, a, side="right")) - 1
            last = int(np.searchsorted(edges, min(a + step, len(values)), side="left"))
            cuts = np.maximum(edges[first:last] - a, 0)
            sums[first:last] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
        over = 2 * sums > counts[some][:, None]
        out[some] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def trie_links(values: np.ndarray, own: int, depth: int, errors: int = ERRORS) -> np.ndarray:
    """Labels of sorted distinct fingerprints by links within ``errors`` bits that touch the subtree ``own`` at ``depth``.

    A node is a range of the sorted array with a common prefix.  Pairs of nodes start
    at the subtree and each other subtree (or itself), with the bits in which their
    prefixes differ; each step takes both nodes to their children, adds a bit where
    these part, and drops a pair once it is over the budget.  Pairs of few
    fingerprints are compared outright.
    """
    forest = Forest(len(values))
    prefixes = (values >> np.uint64(BITS - depth)).astype(np.int64) if depth else np.zeros(len(values), np.int64)
    nodes, starts = np.unique(prefixes, return_index=True)
    ends = np.append(starts[1:], len(values))
    at = int(np.searchsorted(nodes, own))
    if at == len(nodes) or nodes[at] != own:
        return forest.label
    used = np.bitwise_count(nodes ^ own).astype(np.int64)
    near = np.flatnonzero(used <= errors)
    stack = [(depth, np.full(len(near), starts[at]), np.full(len(near), ends[at]), starts[near], ends[near], used[near])]
    while stack:
        d, a0, a1, b0, b1, used = stack.pop()
        if len(a0) > WALKED:
            for part in np.array_split(np.arange(len(a0)), -(-len(a0) // WALKED)):
                stack.append((d, a0[part], a1[part], b0[part], b1[part], used[part]))
            continue
        na, nb = a1 - a0, b1 - b0
        small = na * nb <= SMALL
        if small.any():
            pairs = (na * nb)[small]
            which = np.repeat(np.flatnonzero(small), pairs)
            k = np.arange(len(which)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            i, j = a0[which] + k // nb[which], b0[which] + k % nb[which]
            close = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= errors)
            forest.link(i[close], j[close])
            a0, a1, b0, b1, used = (x[~small] for x in (a0, a1, b0, b1, used))
        if not len(a0) or d == BITS:
            continue
        bit = np.uint64(1 << (BITS - 1 - d))
        below = ~np.uint64((1 << (BITS - d)) - 1)
        am = np.clip(np.searchsorted(values, (values[a0] & below) | bit), a0, a1)
        bm = np.clip(np.searchsorted(values, (values[b0] & below) | bit), b0, b1)
        same = a0 == b0
        kids = [(a0, am, b0, bm, used, None), (am, a1, bm, b1, used, None), (a0, am, bm, b1, used + 1, None), (am, a1, b0, bm, used + 1, ~same)]
        grown = []
        for x0, x1, y0, y1, u, only in kids:
            alive = (x1 > x0) & (y1 > y0) & (u <= errors)
            if only is not None:  # a node with itself: its two children meet once
                alive &= only
            grown.append([x[alive] for x in (x0, x1, y0, y1, u)])
        stack.append((d + 1, *(np.concatenate(x) for x in zip(*grown, strict=True))))
    return forest.label


def _redealt(dealt: DataFrame, depth: int, deeper: int, errors: int) -> DataFrame:
    """Members (fp, node) of nodes at ``depth`` dealt to the nodes' children at ``deeper``: a fingerprint goes to each child within the budget that is not after its own."""
    own = F.shiftrightunsigned("fp", BITS - deeper)
    children = F.transform(F.sequence(F.lit(0), F.lit((1 << (deeper - depth)) - 1)), lambda c: F.shiftleft("node", deeper - depth).bitwiseOR(c.cast("long")))
    return dealt.select("fp", F.explode(F.filter(children, lambda n: (F.bit_count(own.bitwiseXOR(n)) <= errors) & (n <= own))).alias("node"))


def trie_join(ws: Workspace, classes: DataFrame, errors: int = ERRORS, node_size: int = NODE_SIZE) -> DataFrame:
    """Links (u, v) that join all distinct fingerprints ``fp`` within ``errors`` bits, as forests: one for each subtree of the trie (see ``near_duplicates``)."""
    depth = min(max(math.ceil(math.log2(max(classes.count() / node_size, 1))), 5), 16)
    masks = [sum(1 << i for i in bits) for k in range(min(errors, depth) + 1) for bits in combinations(range(depth), k)]
    prefix = F.shiftrightunsigned("fp", BITS - depth)
    nodes = F.filter(F.transform(F.array(*map(F.lit, masks)), lambda m: prefix.bitwiseXOR(m.cast("long"))), lambda q: q <= prefix)
    dealt = classes.select("fp", F.explode(nodes).alias("node"))

    def walker(depth: int) -> Callable[[pa.Table], pa.Table]:
        def walk(table: pa.Table) -> pa.Table:
            node = table.column("node")[0].as_py()
            values = np.sort(table.column("fp").combine_chunks().to_numpy().view(np.uint64))
            label = trie_links(values, node, depth, errors)
            linked = np.flatnonzero(label != np.arange(len(values)))
            return pa.table({"u": values[linked].view(np.int64), "v": values[label[linked]].view(np.int64)})

        return walk

    found = []
    while True:
        crowded = ws.cut(dealt.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > 4 * node_size).select("node"), "crowded")
        last = depth > BITS - 6 or crowded.isEmpty()
        walked = dealt if last else dealt.join(crowded, "node", "left_anti")
        found.append(ws.cut(arrow_groups(walked.groupBy("node"), walker(depth), "u long, v long"), "links"))
        if last:
            break
        dealt = ws.cut(_redealt(dealt.join(crowded, "node", "left_semi"), depth, depth + 6, errors), "dealt")
        depth += 6
    return reduce(DataFrame.union, found)


def near_duplicates(spark: SparkSession, df: DataFrame, width: int = SHINGLE, errors: int = ERRORS, doc_id: str = "doc_id", text: str = "text", node_size: int = NODE_SIZE) -> DataFrame:
    """Fingerprint whole texts and link those within ``errors`` bits; each document with its component.

    Equal fingerprints are one node from the start, so a group of copies of any size
    is one row.  The trie of distinct fingerprints is cut at a depth that suits their
    number; each subtree is walked by a task together with the members of subtrees whose
    prefix differs in at most ``errors`` bits, each pair of subtrees once.  A subtree
    that holds over ``node_size`` members, because fingerprints crowd under its prefix,
    is dealt on to its descendants six bits below, and so on.  A task hands on a
    forest of the links it found, at most one a fingerprint, which keeps every link's
    reach.  The forests are joined by ``connected_components``.  ``errors`` may be any
    number; the copies of a fingerprint that are dealt, and so the work, grow with the
    ways to place them in the cut's depth.

    Returns doc_id (of any type, as it was), fingerprint (16 hex digits) and component_id
    (the smallest doc_id reachable).  Null and empty texts and texts without words have
    fingerprint zero and are linked like any other.  A text of any length is
    fingerprinted whole.  Rows that repeat a doc_id are each returned.  A null doc_id is
    never a smallest one unless its component has no other.  An empty table gives no
    rows.  Further columns are not read.
    """
    ws = Workspace(spark, "simhash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows in byte_slices(whole, "text", 8 << 20):
                found = fingerprints(rows.column("text").cast(pa.binary()).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kind = df.schema[doc_id].dataType
    docs = ws.cut(arrow_map(df.select(named(df, doc_id).alias("doc_id"), text_column(df, text).alias("text")), run, schema_of(("doc_id", kind), ("fp", "long"))), "fingerprints")
    classes = ws.cut(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    return component_of(ws, docs, classes, trie_join(ws, classes, errors, node_size)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def component_of(ws: Workspace, docs: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """Documents (doc_id, fp) with component_id: the least doc_id of all classes (fp, least) that links (u, v) join theirs to.

    Every table is written before it is joined, so that joins stand on plain exchanges,
    whose skewed partitions Spark splits: a class with a third of the documents, or a
    component with a third of the classes, is many tasks.
    """
    labels = ws.cut(connected_components(ws, links), "labels")
    linked = ws.cut(classes.join(labels, classes["fp"] == labels["node"]).select("fp", "least", "label"), "linked")
    least = ws.cut(linked.groupBy("label").agg(F.min("least").alias("component")), "least")
    moved = ws.cut(linked.join(least, "label").select("fp", "component"), "moved")
    known = ws.cut(classes.join(moved, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")), "components")
    return docs.join(known, "fp")
