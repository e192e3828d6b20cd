"""Line dedup over levelled sorted runs of line hashes.

LineRuns keeps, in a folder, runs of (hash, hash, first doc_id) for every line key seen, each key in one run only. A run is bucketed by key and sorted, so that joins with it read its buckets as they stand, without a shuffle or a sort. The keys of a batch of documents are brought into the same buckets once; merged with each run, those in none (the anti-join) form the batch's own run of level 0, and those in one belong to earlier documents. When a level holds FANOUT runs they are merged, bucket by bucket, into one of the next level, so a key is rewritten once a level and a batch meets at most FANOUT - 1 runs of each. A later call can open the folder and go on.

The key of a line is the line without white space at both ends, A-Z in lower case; keys of fewer than 10 code points are never dropped. Batches come in ascending doc_id, so the first document is the smallest that holds a key; documents of a later call on the same folder count as later. Keys are compared by two 64-bit hashes of different seeds.

Cases: null or empty text: one empty line, which stays. Repeated rows or ids: rows with one doc_id are one document: within it no line is dropped for the other row's sake, and both lose what an earlier document holds. Null ids: such a row follows all others as one document of its own, and loses what they hold; rows with null ids are one document too. Documents whose lines are all dropped keep the empty text. Empty table: empty result. dedup_lines() passes other columns through, whatever their names; only a column _lines is replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_CHARS = 10
FANOUT = 2
BATCHES = 4
_KEY = ["_h1", "_h2"]


def _doc():
    """doc_id, with the greatest number for null."""
    return F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))


def lines_of(text: str = "text"):
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(_doc, _t, _pos, _h1, _h2) for every line of docs (doc_id, text); the hashes are null for short keys. _t tells rows with one doc_id apart."""
    rows = docs.select(_doc().alias("_doc"), F.xxhash64("text").alias("_t"), F.posexplode(lines_of()).alias("_pos", "_line"))
    key = F.translate(F.btrim("_line", F.lit(common.SPACE)), common.UPPER, common.LOWER)
    long = F.char_length("_key") >= min_chars
    a, b = common.hashes("_key")
    return rows.select("_doc", "_t", "_pos", key.alias("_key")).select("_doc", "_t", "_pos", F.when(long, a).alias("_h1"), F.when(long, b).alias("_h2"))


class LineRuns:
    """The runs of one collection of lines, by level. root is the collection's folder (a new one in the shared folder if not given); runs that it holds already are opened."""

    COLUMNS = "_h1 long, _h2 long, _first long"

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, root: str | None = None):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.root = root or common.fresh_path(spark, "line-runs")
        for path in common.written(spark, f"{self.root}/level-*/run-*"):
            level, run = path.rsplit("/", 2)[1:]
            self._held(int(level.split("-")[1])).append((path, common.opened(spark, path, self.COLUMNS, _KEY, int(run.split("-")[1]))))

    def _held(self, k: int) -> list:
        self.levels += [[] for _ in range(k + 1 - len(self.levels))]
        return self.levels[k]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for _, run in level]

    def _write(self, run: DataFrame, level: int) -> None:
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        path = f"{self.root}/level-{level}/run-{n}-{uuid.uuid4().hex}"
        self._held(level).append((path, common.bucketed(run.select(*_KEY, "_first"), "line_run", *_KEY, path=path)))

    def add(self, fresh: DataFrame) -> None:
        """Adds a run of keys that are in no other, and merges full levels: runs have no key in common, so a full outer join of buckets is their merge."""
        self._write(fresh, 0)
        k = 0
        while len(self.levels[k]) >= self.fanout:
            old, self.levels[k] = self.levels[k], []
            merged = old[0][1]
            for i, (_, run) in enumerate(old[1:], 2):
                merged = merged.withColumnRenamed("_first", "_a").join(run.withColumnRenamed("_first", "_b").hint("merge"), _KEY, "full").select(*_KEY, F.coalesce("_a", "_b").alias("_first"))
                if i < len(old):  # a full join's result is in no known order
                    merged = common.bucketed(merged, "line_merge", *_KEY)
            self._write(merged, k + 1)
            common.delete(self.spark, *(path for path, _ in old))
            k += 1

    def batch(self, keys: DataFrame, last: bool = False) -> DataFrame:
        """(_doc, _t, _pos) of the lines to drop, of keys (of line_keys()) of documents that follow all earlier ones; adds the batch's own run, unless it is the last batch and nothing will follow."""
        held = keys.filter("_h1 is not null")
        own = held.groupBy(*_KEY).agg(F.min("_doc").alias("_first"), F.max("_doc").alias("_until"))
        with common.sorted_buckets(self.spark):
            own = common.bucketed(own, "line_owners", *_KEY)
            fresh, runs = own, self.runs()
            for run in runs:
                fresh = fresh.join(run.select(*_KEY).hint("merge"), _KEY, "left_anti")
            # keys of one document alone need no join with their lines
            shared = fresh.filter("_first < _until").select(*_KEY, F.col("_first").alias("_owner"))
            for run in runs:
                shared = shared.unionByName(own.join(run.select(*_KEY).hint("merge"), _KEY, "left_semi").select(*_KEY, F.lit(None).cast("long").alias("_owner")))
            shared = common.stored(shared, "shared-lines")
            if not last:
                self.add(fresh)
        return held.join(shared, _KEY).filter(F.col("_owner").isNull() | (F.col("_doc") != F.col("_owner"))).select("_doc", "_t", "_pos")


def dropped(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, root: str | None = None) -> DataFrame:
    """(_doc, _t, _pos) of the lines that go, batch by batch in the order of doc_id. With root, the lines of earlier calls on that folder count, and it keeps those of this one."""
    keys = line_keys(docs, min_chars)
    cuts = docs.agg(F.expr(f"percentile_approx(doc_id, array({', '.join(str(i / batches) for i in range(1, batches))}), 10000)")).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    number = sum((F.when(F.col("_doc") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    keys = common.stored(keys.withColumn("_batch", number), "line-keys", "_batch")
    runs, found = LineRuns(docs.sparkSession, fanout, root), None
    for i in range(len(cuts) + 1):
        gone = runs.batch(keys.filter(F.col("_batch") == i).drop("_batch"), last=i == len(cuts) and root is None)
        found = gone if found is None else found.unionByName(gone)
    return found


def lines_left(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, root: str | None = None) -> DataFrame:
    """For each row of docs itself as the struct _row, and the struct _lines (n_lines, n_dropped, text), text being what is left."""
    gone = dropped(docs.select("doc_id", "text"), min_chars, batches, fanout, root)
    # a set, as repeated rows give the same places
    gone = gone.groupBy("_doc", "_t").agg(F.array_sort(F.collect_set("_pos")).alias("_gone"))
    rows = docs.select(F.struct("*").alias("_row"), _doc().alias("_doc"), F.xxhash64("text").alias("_t"), "text")
    rows = rows.join(gone, ["_doc", "_t"], "left")
    # the kept lines between one dropped place and the next, so that long documents take linear time
    n, lines = F.size("_all"), F.col("_all")
    stops = F.concat("_gone", F.array(n))
    parts = F.transform(stops, lambda at, i: F.slice(lines, F.when(i == 0, 1).otherwise(F.get(stops, i - 1) + 2), at - F.when(i == 0, 0).otherwise(F.get(stops, i - 1) + 1)))
    left = F.when(F.col("_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.flatten(parts), "\n"))
    rows = rows.withColumn("_all", lines_of())
    info = F.struct(n.cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"), left.alias("text"))
    return rows.select("_row", info.alias("_lines"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, root: str | None = None) -> DataFrame:
    """docs with the struct _lines (n_lines, n_dropped, text)."""
    left = lines_left(docs, min_chars, batches, fanout, root)
    return left.select(*(common.of("_row", c) for c in docs.columns if c != "_lines"), "_lines")


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's number of lines, of dropped lines, and the digest of what is left."""
    docs = lines_left(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("_row.doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2(F.col("_lines.text"), 256).alias("kept_sha256"))


_PLACES = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP4_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_PLACES}), '{common.UPPER}', '{common.LOWER}') AS key FROM l),
o AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
f AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> o.first, false) AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
