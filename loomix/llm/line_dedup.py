"""Line dedup with sharded cuckoo filters over exact reference counts; insertions and deletions are reversible.

A line's key is the line stripped of ASCII white space at both ends with A-Z lower-cased; keys of
fewer than ``min_length`` code points don't count. The index is a folder that all executors share:

* log-N, the postings (key, doc_id, sign) of the N-th update: +1 for each key of an inserted row, -1
  when the row is deleted. A document holds a key while its signs sum to more than zero;
* counts-N, the exact reference counts (number of documents that hold the key, and the largest of them,
  the keeper of its lines) of the keys that the N-th update touched; later ones hold;
* shards-N, the shards that the update changed: a cuckoo filter of the shard's frequent keys, those of at
  least ``min_docs`` documents, and their exact counts. Keys are dealt to shards by hash; the number of
  shards doubles as the postings grow, so that a shard stays a few hundred kilobytes at any size;
* state-N, written last. open() takes up the last finished state; what a broken update left is overwritten.

An update reads the log only for keys that it touches, and merges their new counts into the filters and
tables of their shards: keys that became frequent are inserted, ones that ceased to be are deleted.

To dedup documents, their keys are dealt to the shards, where a shard's filter is looked up first and hits
then in its exact counts, so that false positives change nothing. Keys that hold more than one in 16384 of all
postings - fewer than 16384 keys, whatever the size - are looked up before dealing, so no shard gets the
lines of a third of all documents.

Keys are compared by two independent 64-bit hashes. Defined results: a null or empty text is one empty
line; rows with a null id neither count nor lose lines; rows that repeat an id are one document: they count
once, and all keep the lines whose keeper is that id; an empty table gives an empty result; other columns
are ignored. A row must be deleted with the text it was inserted with.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..paths import new_path
from ._store import apart, union
from ._text import U64, WHITE_SEP, lines, mix, of_text, signed, slices

if TYPE_CHECKING:
    import pandas as pd  # executors load it only where a step needs it

#: Postings for each shard, at most twice as many.
PER_SHARD = 1 << 13
#: Keys with more than one in so many of all postings are looked up before lines are dealt out.
HOT = 1 << 14


def line_keys(s, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Both hashes of the key of each line, whether it counts, the line's text, and the lines themselves."""
    starts, ends, first = lines(s)
    solid = np.flatnonzero(~WHITE_SEP[s.data])
    at, to = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = to > at
    a, b = starts.copy(), starts.copy()
    a[some], b[some] = solid[at[some]], solid[to[some] - 1] + 1
    points = np.concatenate([[0], np.cumsum((s.data & 0xC0) != 0x80)])
    counts = points[b] - points[a] >= min_length
    h1 = s.hashes(a, b, lower=True)
    h2 = s.hashes(a, b, lower=True, seed=12)
    return h1, h2, counts, of_text(first), (starts, ends, first)


class CuckooFilter:
    """Four 16-bit fingerprints a bucket; each key has two buckets. Supports deletion of inserted keys."""

    SLOTS, KICKS = 4, 500

    def __init__(self, table: np.ndarray):
        self.table = table.reshape(-1, self.SLOTS)

    @classmethod
    def empty(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (0.8 * cls.SLOTS) + 1))))
        return cls(np.zeros((buckets, cls.SLOTS), np.uint16))

    @classmethod
    def of(cls, h: np.ndarray) -> CuckooFilter:
        size = len(h)
        while not (out := cls.empty(size)).insert(h):
            size = max(8, 2 * size)
        return out

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = np.maximum((h >> U64(48)).astype(np.uint16), 1)
        one = (h & U64(len(self.table) - 1)).astype(np.int64)
        return mark, one, self._partner(one, mark)

    def _partner(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(mark.astype(U64)) & U64(len(self.table) - 1)).astype(np.int64)

    def __contains__(self, h: int) -> bool:
        return bool(self.contains(np.array([h], U64))[0])

    def contains(self, h: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(h)
        return (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)

    def insert(self, h: np.ndarray) -> bool:
        """False if a key found no place; the filter must then be built anew, larger.

        All keys move at once: in each round a bucket takes as many as it has room for, and of the others
        each goes to its other bucket or, the second time, one of them takes the place of a key that moves on.
        """
        rng = np.random.default_rng(len(self.table))
        mark, at, _ = self._places(h)
        second = np.zeros(len(h), bool)
        for _ in range(self.KICKS):
            if not len(mark):
                return True
            order = np.argsort(at, kind="stable")
            mark, at, second = mark[order], at[order], second[order]
            new = np.ones(len(at), bool)
            new[1:] = at[1:] != at[:-1]
            begin = np.flatnonzero(new)
            rank = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
            free = self.table[at] == 0
            slot = np.argsort(~free, axis=1, kind="stable")  # free ones first
            fits = rank < free.sum(1)
            self.table[at[fits], slot[fits, rank[fits]]] = mark[fits]
            mark, at, second, rank = mark[~fits], at[~fits], second[~fits], rank[~fits]
            kick = np.flatnonzero(second)
            kick = kick[np.unique(at[kick], return_index=True)[1]]
            k = rng.integers(self.SLOTS, size=len(kick))
            out = self.table[at[kick], k].copy()
            self.table[at[kick], k] = mark[kick]
            mark[kick] = out
            moves = ~second
            moves[kick] = True
            at[moves] = self._partner(at[moves], mark[moves])
            second |= moves
        return not len(mark)

    def delete(self, h: np.ndarray) -> None:
        mark, one, two = self._places(h)
        for m, i, j in zip(mark.tolist(), one.tolist(), two.tolist()):
            for place in (i, j):
                found = np.flatnonzero(self.table[place] == m)
                if len(found):
                    self.table[place, found[0]] = 0
                    break
            else:
                raise KeyError("a key that was never inserted")


#: A key's row in a shard: both hashes, number of documents, keeper.
ROW = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("n", "<i8"), ("keeper", "<i8")])
LOG, COUNTS, SHARDS = "h1 long, h2 long, doc long, sign int", "h1 long, h2 long, n_docs long, keeper long", "shard long, filter binary, keys binary"


def _rows(pdf: pd.DataFrame) -> np.ndarray:
    """A shard's keys as rows, ascending."""
    out = np.zeros(len(pdf), ROW)
    for name, column in (("h1", "h1"), ("h2", "h2"), ("n", "n_docs"), ("keeper", "keeper")):
        out[name] = pdf[column].fillna(0).to_numpy(np.int64).view(ROW[name].str)
    return np.sort(out, order=["h1", "h2"])


def _shard(shard: int, filter_: CuckooFilter, rows: np.ndarray) -> pd.DataFrame:
    import pandas as pd

    return pd.DataFrame({"shard": [shard], "filter": [filter_.table.tobytes()], "keys": [rows.tobytes()]})


def _merge(was: pd.DataFrame, now: np.ndarray, shard: int, min_docs: int) -> pd.DataFrame:
    """A shard with the counts of some of its keys replaced; its filter takes only the keys that come or go."""
    old = np.frombuffer(was["keys"].iloc[0], ROW) if len(was) else np.zeros(0, ROW)
    key = lambda x: np.column_stack([x["h1"], x["h2"]]).view([("a", "<u8"), ("b", "<u8")]).reshape(-1)
    rows = np.sort(np.concatenate([old[~np.isin(key(old), key(now))], now[now["n"] >= min_docs]]), order=["h1", "h2"])
    gone, come = old[~np.isin(key(old), key(rows))], rows[~np.isin(key(rows), key(old))]
    filter_ = CuckooFilter(np.frombuffer(was["filter"].iloc[0], np.uint16).copy()) if len(was) else CuckooFilter.empty(len(come))
    filter_.delete(gone["h1"])
    if len(rows) > 0.9 * filter_.table.size or not filter_.insert(come["h1"]):
        filter_ = CuckooFilter.of(rows["h1"])
    return _shard(shard, filter_, rows)


class LineIndex:
    """The index of the lines of some documents, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, min_docs: int = 5, min_length: int = 40, shards: int = 16, path: str | None = None):
        self.spark, self.min_docs, self.min_length, self.least_shards = spark, min_docs, min_length, shards
        self.path, self.version, self.base, self.shards, self.postings = path or new_path(spark, "lines"), 0, 1, shards, 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineIndex:
        """The index in a folder, as the last finished update left it."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        done = [int(n[6:]) for n in names if n.startswith("state-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
        out = cls(spark, path=path)
        if done:
            row = spark.read.parquet(f"{path}/state-{max(done)}").first()
            for name in ("min_docs", "min_length", "least_shards", "version", "base", "shards", "postings"):
                setattr(out, name, row[name])
        return out

    def _write(self, df: DataFrame, name: str, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}-{version}")

    def _read(self, name: str, schema: str, version: int) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}-{version}")

    def _latest(self, name: str, schema: str, by: list[str], first: int, last: int) -> DataFrame:
        """The rows of the last version that has them."""
        if first == last:
            return self._read(name, schema, first)
        every = union([self._read(name, schema, v).withColumn("version", F.lit(v)) for v in range(first, last + 1)])
        rest = [c for c in every.columns if c not in (*by, "version")]
        return every.groupBy(*by).agg(F.max_by(F.struct(*rest), "version").alias("x")).select(*by, "x.*")

    def counts(self) -> DataFrame:
        """(h1, h2, n_docs, keeper) of every key ever inserted."""
        if not self.version:
            return self.spark.createDataFrame([], COUNTS)
        return self._latest("counts", COUNTS, ["h1", "h2"], 1, self.version)

    def _postings(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
        least = self.min_length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, s in slices(batches):
                h1, h2, counts, text, _ = line_keys(s, least)
                at = np.flatnonzero(counts)
                at = at[np.unique(mix(h1[at] ^ mix(text[at].astype(U64) + U64(1))), return_index=True)[1]]  # each key once a row
                ids = s.ids.to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(signed(h1[at])), pa.array(signed(h2[at])), pa.array(ids[text[at]], pa.int64())], ["h1", "h2", "doc"])

        return rows.mapInArrow(run, "h1 long, h2 long, doc long")

    def _shard_of(self):
        return F.pmod(F.col("h2"), F.lit(self.shards))

    def _update(self, docs: DataFrame, sign: int, id_col: str, text_col: str) -> LineIndex:
        """Appends to the log, counts anew what it touches, and brings the shards up to date."""
        v = self.version + 1
        self._write(self._postings(docs, id_col, text_col).withColumn("sign", F.lit(sign)), "log", v)
        new = self._read("log", LOG, v)
        touched = new.select("h1", "h2").distinct()
        whole = new if v == 1 else union([self._read("log", LOG, k) for k in range(1, v + 1)]).join(touched, ["h1", "h2"], "left_semi")
        per = whole.groupBy("h1", "h2", "doc").agg(F.sum("sign").alias("n")).where("n > 0")
        counts = per.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper"))
        if v > 1:
            counts = touched.join(counts, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "keeper")
        self._write(counts, "counts", v)
        self.version = v
        self.postings = self.counts().agg(F.sum("n_docs")).first()[0] or 0
        self._update_shards()
        state = (self.min_docs, self.min_length, self.least_shards, self.version, self.base, self.shards, self.postings)
        names = "min_docs int, min_length int, least_shards int, version int, base int, shards long, postings long"
        self._write(self.spark.createDataFrame([state], names).coalesce(1), "state", v)
        return self

    def _update_shards(self) -> None:
        least, v = self.min_docs, self.version
        wanted = max(self.least_shards, 1 << max(0, (max(1, self.postings) // PER_SHARD - 1).bit_length()))
        if v == 1 or wanted > 2 * self.shards:
            self.base, self.shards = v, wanted

            def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
                rows = _rows(pdf)
                return _shard(key[0], CuckooFilter.of(rows["h1"]), rows)

            frequent = self.counts().where(F.col("n_docs") >= least).withColumn("shard", self._shard_of())
            self._write(frequent.groupBy("shard").applyInPandas(build, SHARDS), "shards", v)
            return
        change = self._read("counts", COUNTS, v).withColumn("shard", self._shard_of())
        old = self._latest("shards", SHARDS, ["shard"], self.base, v - 1).join(change.select("shard").distinct(), "shard", "left_semi")

        def merge(key: tuple, was: pd.DataFrame, now: pd.DataFrame) -> pd.DataFrame:
            return _merge(was, _rows(now), key[0], least)

        self._write(old.groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(merge, SHARDS), "shards", v)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        return self._update(docs, 1, id_col, text_col)

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        return self._update(docs, -1, id_col, text_col)

    def _dropped(self, keys: DataFrame) -> DataFrame:
        """(id, drops): the keys, packed, whose lines a document loses. keys: h1, h2, id."""
        if not self.version:
            return self.spark.createDataFrame([], "id long, drops array<binary>")
        hot = self.counts().where((F.col("n_docs") > self.postings / HOT) & (F.col("n_docs") >= self.min_docs)).collect()  # fewer than HOT rows
        hot = np.sort(np.array([(r["h1"] & (2**64 - 1), r["h2"] & (2**64 - 1), r["n_docs"], r["keeper"]) for r in hot], ROW), order=["h1", "h2"])
        shared = self.spark.sparkContext.broadcast(hot)

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hot = shared.value
            for batch in batches:
                h1, h2, ids = (batch.column(i).to_numpy() for i in range(3))
                row = _lookup(hot, h1.view(U64), h2.view(U64))
                drop = (row >= 0) & (hot["keeper"][row] != ids) if len(hot) else np.zeros(len(ids), bool)
                for take, kind in ((drop, 2), (row < 0, 1)):
                    yield pa.RecordBatch.from_arrays([pa.array(x[take]) for x in (h1, h2, ids)] + [pa.array(np.full(int(take.sum()), kind, np.int32))], ["h1", "h2", "id", "kind"])

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows arrive by shard, a shard's filter and counts before its lines."""
            shard = filter_ = rows = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                kind, number, h1, h2, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
                cuts = np.flatnonzero((kind == 0) | (np.diff(number, prepend=number[0] - 1) != 0)).tolist()
                for a, b in zip(cuts, [*cuts[1:], len(kind)]):
                    if kind[a] == 0:
                        shard, filter_, rows = number[a], CuckooFilter(np.frombuffer(batch.column(5)[a].as_py(), np.uint16)), np.frombuffer(batch.column(6)[a].as_py(), ROW)
                        a += 1
                    if a == b:
                        continue
                    one, two, own, drop = h1[a:b].astype(np.int64), h2[a:b].astype(np.int64), ids[a:b].astype(np.int64), kind[a:b] == 2
                    if number[a] == shard:
                        at = np.flatnonzero(~drop)
                        at = at[filter_.contains(one[at].view(U64))]
                        row = _lookup(rows, one[at].view(U64), two[at].view(U64))
                        at, row = at[row >= 0], row[row >= 0]
                        drop[at] = rows["keeper"][row] != own[at]
                    packed = np.column_stack([one[drop], two[drop]]).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array(own[drop]), pa.array([packed[16 * i : 16 * i + 16] for i in range(int(drop.sum()))], pa.binary())], ["id", "drop"])

        order = ["kind", "shard", "h1", "h2", "id", "filter", "keys"]
        none = lambda kind: F.lit(None).cast(kind)
        dealt = keys.mapInArrow(first, "h1 long, h2 long, id long, kind int").withColumns({"shard": F.when(F.col("kind") == 1, self._shard_of()).otherwise(F.pmod(F.xxhash64("id"), F.lit(self.shards))), "filter": none("binary"), "keys": none("binary")})
        held = self._latest("shards", SHARDS, ["shard"], self.base, self.version).select(F.lit(0).alias("kind"), "shard", F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("id"), "filter", "keys")
        met = dealt.select(*order).unionByName(held.select(*order)).repartition("shard").sortWithinPartitions("shard", "kind")
        return met.mapInArrow(look, "id long, drop binary").groupBy("id").agg(F.collect_set("drop").alias("drops"))

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, postings: DataFrame | None = None) -> DataFrame:
        """The columns ``keep`` (the id by default), text without the dropped lines, n_lines and n_dropped of each row.

        postings: the keys of these documents (h1, h2, doc), if they are at hand, as after their insertion.
        """
        keep = [id_col] if keep is None else keep
        names = [f"_{i}" for i in range(len(keep))]
        rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), *keep).toDF("id", "text", *names)
        keys = self._postings(docs, id_col, text_col) if postings is None else postings
        gone = self._dropped(keys.select("h1", "h2", F.col("doc").alias("id")))
        joined = rows.join(gone, "id", "left").select("id", "text", "drops", *names)
        least = self.min_length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, s in slices(batches):
                feeds = np.concatenate([[0], np.cumsum(s.data == 0x0A)])
                n_lines = 1 + feeds[s.offsets[1:]] - feeds[s.offsets[:-1]]
                lost = np.zeros(len(s), np.int64)
                texts: list = [None] * len(s)
                drops = batch.column(2)
                some = np.flatnonzero(drops.is_valid().to_numpy(zero_copy_only=False))
                if len(some):
                    h1, h2, counts, _, (starts, ends, first) = line_keys(s, least)
                    raw = np.column_stack([signed(h1), signed(h2)]).tobytes()
                for i in some.tolist():
                    gone = set(drops[i].as_py())
                    r = range(first[i], first[i + 1])
                    kept = [k for k in r if not (counts[k] and raw[16 * k : 16 * k + 16] in gone)]
                    lost[i] = len(r) - len(kept)
                    texts[i] = b"\n".join([s.data[starts[k] : ends[k]].tobytes() for k in kept]).decode()
                source = batch.column(1)
                text = pa.array([t if t is not None else source[i].as_py() or "" for i, t in enumerate(texts)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[3:], text, pa.array(n_lines.astype(np.int64)), pa.array(lost)], [*names, "text", "n_lines", "n_dropped"])

        kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
        out = joined.mapInArrow(run, f"{kinds}, text string, n_lines long, n_dropped long")
        return out.toDF(*keep, *apart(keep, text_col, "n_lines", "n_dropped"))


def _lookup(rows: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The place of each key among ascending rows, or -1."""
    if not len(rows):
        return np.full(len(h1), -1)
    at = np.searchsorted(rows["h1"], h1)
    out = np.full(len(h1), -1)
    left = np.arange(len(h1))
    while len(left):  # keys that share their first hash follow one another
        left = left[at[left] < len(rows)]
        left = left[rows["h1"][at[left]] == h1[left]]
        same = rows["h2"][at[left]] == h2[left]
        out[left[same]] = at[left[same]]
        left = left[~same]
        at[left] += 1
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 5, min_length: int = 40, keep: list[str] | None = None) -> DataFrame:
    """Indexes all documents and drops their repeated lines; see LineIndex.dedup()."""
    index = LineIndex(docs.sparkSession, min_docs, min_length)
    index.insert(docs, id_col, text_col)
    return index.dedup(docs, id_col, text_col, keep, postings=index._read("log", LOG, 1))


def oracle() -> str:
    """DuckDB SQL for op10's rows."""
    return r"""
    WITH l AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k FROM documents),
    n AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    f AS (SELECT key, max(doc_id) AS keeper FROM n WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    j AS (SELECT n.*, f.keeper IS NOT NULL AND f.keeper <> n.doc_id AS gone FROM n LEFT JOIN f USING (key))
    SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM j GROUP BY doc_id"""
