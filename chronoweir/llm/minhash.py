"""Near-duplicates by MinHash with fast similarity sketches, banding and exact confirmation.

A sketch has t coordinates. In round i < t every shingle is hashed to a bin and a value, in round t + i all go to bin i; a bin keeps the least value of the first round that reaches it. So each coordinate is filled for certain, long documents need one round, and the share of equal coordinates of two sketches is concentrated about the similarity of their sets. Rows of coordinates form bands; documents with an equal band are candidates. The number of bands is such that a pair at the threshold is missed with a probability under MISS.

1. Documents with the same words (told apart by SHA-256 of the lower-cased words) are one node. Nodes are numbered in the order of their smallest doc_id, null last.
2. Nodes with an equal band are candidates of each other. Each is compared first with its hub, the smallest node of all its bands, in blocks of up to BLOCK nodes and a hub: so near copies of one text are joined in linear time.
3. Bands whose nodes are one component by now are done. Links among the nodes of the others are confirmed band by band (once for bands with the same nodes): a band of up to BLOCK nodes is one block; a larger one is dealt to blocks by hash, and pairs of blocks are compared, so no band is in one task. A block gives only a forest of its links, at most one row a node.
4. The components of all links are the result.

Links are confirmed on full sets of shingles of real words, which are numbered in each batch of blocks by comparing their bytes. Only step 3 takes time with the square of a band's nodes: those of different texts that are near the threshold, and yet not all linked. They are matrix products inside blocks, never rows. Texts are shuffled once; those of candidates are then read from a table in the shared folder.

Cases: null or empty text, or no words: an empty set, linked with nothing. Fewer words than a shingle: all words as one shingle. Repeated rows: equal sets, so one component. Rows of one id with different texts are different nodes. Null ids: linked like others; a component's id is its smallest doc_id, null if it has none. Very long texts: whole sets, blocks are bounded by shingles too. Empty table: empty result. near_dedup() passes other columns through, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components
from .words import exact_shingles, exact_words, mixed, shingle_numbers, word_numbers

MISS = 1e-8
#: Nodes, and shingles on average, that a block may have.
BLOCK, BLOCK_SHINGLES = 256, 500_000
_TOP = np.uint64(2**64 - 1)


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows of a band for a threshold."""
    rows = 6 if percent >= 85 else 5
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** rows)), rows


def sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as 64-bit numbers, and how many each has."""
    words, counts = word_numbers([t.encode() for t in texts], lower=True)
    value, n = shingle_numbers(words, counts, k)
    doc = np.repeat(np.arange(len(texts)), n)
    with np.errstate(over="ignore"):
        key = mixed(value + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.sort(np.unique(key, return_index=True)[1])
    return value[first], np.bincount(doc[first], minlength=len(texts))


def sketches(value: np.ndarray, counts: np.ndarray, t: int) -> np.ndarray:
    """A row of t coordinates for each set; rows of empty sets are all ones."""
    n = len(counts)
    flat = np.full(n * t, _TOP)
    doc = np.repeat(np.arange(n), counts)
    for i in range(2 * t):
        if not len(value):
            break
        with np.errstate(over="ignore"):
            h = mixed(value ^ (np.uint64(i + 1) * np.uint64(0xD1342543DE82EF95)))
        at = doc * t + ((h >> np.uint64(40)).astype(np.int64) % t if i < t else i - t)
        free = flat[at] == _TOP
        np.minimum.at(flat, at[free], h[free])
        full = (flat.reshape(n, t) != _TOP).all(1)
        left = ~full[doc]
        if not left.all():
            value, doc = value[left], doc[left]
    return flat.reshape(n, t)


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit number for each band, which differs between bands."""
    n, t = sketch.shape
    parts = sketch.reshape(n, t // rows, rows)
    out = np.arange(t // rows, dtype=np.uint64)[None, :].repeat(n, 0)
    with np.errstate(over="ignore"):
        for j in range(rows):
            out = mixed(out * np.uint64(31) + parts[:, :, j])
    return out


_TO_LOWER = bytes.maketrans(common.UPPER.encode(), common.LOWER.encode())


def text_digest(text: str = "text"):
    """What sketched() has for a text in _t."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def sketched(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, _t, n_shingles, _words, _bands) of docs (doc_id, text): digests of the text and of its words in lower case, the size of the set, and its bands (none for empty sets)."""
    number, rows = banding(percent)

    def run(batches):
        for batch in batches:
            for part in common.slices(batch):
                texts = common.texts(part)
                raw = [t.encode() for t in texts]
                value, counts = sets(texts, k)
                found = bands(sketches(value, counts, number * rows), rows)[counts > 0]
                offsets = np.concatenate([[0], np.cumsum(np.where(counts > 0, number, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel().view(np.int64)))
                digests = [[hashlib.sha256(x).digest() for x in y] for y in (raw, (b" ".join(t.translate(_TO_LOWER).split()) for t in raw))]
                columns = [part.column("doc_id"), pa.array(digests[0], pa.binary()), pa.array(counts.astype(np.int64)), pa.array(digests[1], pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_t", "n_shingles", "_words", "_bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, _t binary, n_shingles long, _words binary, _bands array<long>")


def exact_sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as numbers that are equal for equal shingles and only for them, and how many each has."""
    value, n = exact_shingles(*exact_words([t.encode() for t in texts], lower=True), k)
    key = np.unique((np.repeat(np.arange(len(texts), dtype=np.uint64), n) << np.uint64(32)) | value)
    return key & np.uint64(0xFFFFFFFF), np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(texts))


def linked(value: np.ndarray, counts: np.ndarray, left: np.ndarray, percent: int) -> np.ndarray:
    """The smallest place in each text's component of links, in a block of texts with such sets; with left (booleans), only links between one side and the other count, if there are both."""
    n = len(counts)
    doc = np.repeat(np.arange(n), counts)
    order = np.argsort(value, kind="stable")
    value, doc = value[order], doc[order]
    fresh = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.empty(0, bool)
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1 if len(value) else np.empty(0, bool)
    doc, column = doc[shared], column[shared]
    common_ = np.zeros((n, n), np.float32)
    if len(column):
        fresh = np.concatenate([[True], column[1:] != column[:-1]])
        column = np.cumsum(fresh) - 1
        width = max(256, (4 << 20) // n)
        cuts = np.searchsorted(column, np.arange(0, column[-1] + 1 + width, width))
        for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            m = np.zeros((n, min(width, column[-1] + 1 - i * width)), np.float32)
            m[doc[x:y], column[x:y] - i * width] = 1
            common_ += m @ m.T
    inter = np.rint(common_).astype(np.int64)
    link = (100 * inter >= percent * (counts[:, None] + counts[None, :] - inter)) & (inter > 0)
    if left.any() and not left.all():
        link &= left[:, None] != left[None, :]
    label = np.arange(n)
    np.fill_diagonal(link, True)
    while True:
        new = np.where(link, label[None, :], n).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b), enough to connect what is linked, in each group (cluster, i, j) of rows (node, text, block); with i < j only those between blocks i and j."""
    by = ["cluster", "i", "j"]

    def groups(table: pa.Table):
        """Links in whole groups."""
        node, block, *key = (table.column(c).to_numpy() for c in ("node", "block", *by))
        value, counts = exact_sets([x or "" for x in table.column("text").to_pylist()], k)
        ends = np.cumsum(counts)
        a, b = [], []
        for x, y in zip(*_bounds(key), strict=True):
            left = block[x:y] == key[1][x] if key[1][x] != key[2][x] else np.zeros(y - x, bool)
            label = linked(value[ends[x] - counts[x] : ends[y - 1]], counts[x:y], left, percent)
            some = np.flatnonzero(label != np.arange(y - x))
            a.append(node[x:y][some]), b.append(node[x:y][label[some]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (a, b)], names=["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.nbytes for x in held) > 2 << 20:
                table = pa.Table.from_batches(held)
                start = int(_bounds([table.column(c).to_numpy() for c in by])[0][-1])  # the last group may go on
                if start:
                    yield groups(table.slice(0, start))
                    held = table.slice(start).combine_chunks().to_batches()
        if held:
            yield groups(pa.Table.from_batches(held))

    # a number of partitions, as time and not size is what a partition takes
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*by, "node", "text", "block").repartition(n, *by).sortWithinPartitions(*by, "node").mapInArrow(run, "a long, b long")


def _bounds(key: list[np.ndarray]):
    """Starts and ends of runs of equal rows of some columns."""
    fresh = np.ones(len(key[0]), bool)
    fresh[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in key])
    start = np.flatnonzero(fresh)
    return start, np.append(start[1:], len(fresh))


def _dealt(texts: DataFrame, cluster: str) -> tuple[DataFrame, DataFrame]:
    """texts (node, text, n, cluster) with blocks, the number of blocks of the cluster, and block; and the numbers by cluster."""
    # a table, so that the join's shuffle can split a cluster
    sizes = common.stored(texts.groupBy(cluster).agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "blocks")
    return texts.join(sizes, cluster).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), sizes


def near_hubs(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links of texts (node, text, n, hub) in blocks of one hub, the hub's text being in each."""
    dealt, sizes = _dealt(texts, "hub")
    hubs = texts.select(F.col("node").alias("hub"), "node", "text").join(sizes, "hub").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = dealt.select("hub", "node", "text", "block").unionByName(hubs.select("hub", "node", "text", "block"))
    return _links(rows.select(F.col("hub").alias("cluster"), F.col("block").alias("i"), F.col("block").alias("j"), "node", "text", "block"), k, percent)


def confirmed(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links of texts (node, text, n, cluster), each pair of a cluster's blocks compared."""
    dealt, _ = _dealt(texts, "cluster")
    rows = dealt.select("cluster", "node", "text", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return _links(rows.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "text", "block"), k, percent)


def _whole(found: DataFrame) -> DataFrame:
    """components() with the least nodes too."""
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def _numbered(full: DataFrame) -> DataFrame:
    """(_words, node, rep) of sketches: a number for each text of words, in the order of the smallest doc_id (null last), and the row that stands for it."""
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_t")).alias("rep")
    n = int(full.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["rep.none", "rep.doc_id", "_words"]
    nodes = common.stored(full.groupBy("_words").agg(rep), "least")
    return common.stored(nodes.repartitionByRange(n, *order).sortWithinPartitions(*order).select("_words", F.monotonically_increasing_id().alias("node"), "rep"), "numbers")


def _open(shared: DataFrame, joined: DataFrame) -> DataFrame:
    """(node, cluster) for bands whose nodes aren't one component yet; of bands with the same nodes (told by their number, ends and 128 bits of hashes) there is one."""
    now = shared.join(joined, "node", "left").select("node", "band", F.coalesce("component", "node").alias("now"))
    a, b = common.hashes(F.col("node"))
    found = now.groupBy("band").agg(F.min("now").alias("_x"), F.max("now").alias("_y"), F.count("*").alias("n"), F.bit_xor(a).alias("a"), F.bit_xor(b).alias("b")).filter("_x < _y")
    once = common.stored(found.groupBy("n", "a", "b").agg(F.min("band").alias("band")).select("band"), "open-bands")
    return shared.join(once, "band").select("node", F.col("band").alias("cluster"))


def members(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, _t, n_shingles, component, component_id) for each row of docs (doc_id, text); component is null where the text has no words."""
    made = common.stored(sketched(docs, k, percent), "sketches")
    full = made.filter("n_shingles > 0")
    nodes = _numbered(full)
    stands = (F.col("_t") == F.col("rep._t")) & F.col("doc_id").eqNullSafe(F.col("rep.doc_id"))
    membership = full.join(nodes, "_words").select("doc_id", "_t", "n_shingles", "node", stands.alias("stands"), F.when(stands, F.col("_bands")).alias("_bands"))
    membership = common.stored(membership, "nodes")
    own = membership.filter("stands").select("doc_id", "_t", "node", F.col("n_shingles").alias("n"))
    # rows that repeat whole would stand for their node more than once
    repeated = not own.groupBy("node").count().filter("count > 1").isEmpty()
    banded = membership.filter("stands").select("node", F.explode("_bands").alias("band"))
    banded = common.stored(banded.distinct() if repeated else banded, "bands")
    shared = banded.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last").select("band", "first")
    shared = common.stored(banded.join(common.stored(shared, "first-of-bands"), "band"), "shared-bands")
    hubs = (own.distinct() if repeated else own).join(shared.groupBy("node").agg(F.min("first").alias("hub")), "node")
    # texts are shuffled once at any size: a broadcast of the members would stop working as they grow
    rows = docs.select(F.col("doc_id").alias("_id"), text_digest().alias("_digest"), "text")
    texts = rows.join(hubs.hint("merge"), (F.col("_digest") == F.col("_t")) & F.col("_id").eqNullSafe(F.col("doc_id"))).select("node", "text", "n", "hub")
    if repeated:
        texts = texts.groupBy("node").agg(*(F.first(c).alias(c) for c in ("text", "n", "hub")))
    texts = common.stored(texts, "candidates")
    links = common.stored(near_hubs(texts, k, percent), "links")
    clusters = _open(shared, _whole(components(links)))
    rest = confirmed(texts.select("node", "text", "n").join(clusters, "node"), k, percent)
    found = components(links.unionByName(rest))
    found = membership.join(found, "node", "left").select("doc_id", "_t", "n_shingles", F.coalesce("component", "node").alias("component"))
    # a component is numbered as the node of its smallest doc_id
    ids = nodes.select(F.col("node").alias("component"), F.col("rep.doc_id").alias("component_id"))
    found = found.join(ids, "component").select("doc_id", "_t", "n_shingles", "component", "component_id")
    none = made.filter("n_shingles = 0").select("doc_id", "_t", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return found.unionByName(none)


def classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text)."""
    return members(docs, k, percent).select("doc_id", "n_shingles", "component_id")


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component, that of the smallest doc_id (of more rows with that id, the one whose text has the least digest), and all rows without words."""
    found = members(docs.select("doc_id", "text"), k, percent).filter("component is not null")
    kept = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_t")).alias("least"), F.count("*").alias("n"))
    kept = common.stored(kept.select(F.col("least.doc_id").alias("_id"), F.col("least._t").alias("_digest"), "n"), "kept")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), text_digest().alias("_text"), (F.length(F.btrim(F.coalesce("text", F.lit("")), F.lit(common.SPACE))) == 0).alias("_none"))
    left = rows.filter("not _none").join(kept.hint("merge"), (F.col("_text") == F.col("_digest")) & F.col("_doc").eqNullSafe(F.col("_id")))
    # a row that repeats whole stays once
    turn = F.row_number().over(Window.partitionBy("_text", "_doc").orderBy("_text"))
    return left.withColumn("_turn", turn).filter("_turn = 1").select("_row.*").unionByName(rows.filter("_none").select("_row.*"))


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and component, with shingles of 3 words and a similarity of 85 % or more."""
    found = classes(common.table(spark, sf_dir, "documents"), 3, 85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


OP10_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 2 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d
), n AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id > b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)
), both_ AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT x, y AS least FROM both_ UNION SELECT both_.x, r.least FROM both_ JOIN r ON both_.y = r.x
), c AS (
  SELECT x, min(least) AS least FROM r GROUP BY x
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.least, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.x = d.doc_id
"""
