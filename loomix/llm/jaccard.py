"""N-gram Jaccard join: groups of documents whose sets of word shingles are similar.

The join is exact up to 64-bit hashes of shingles. Documents with equal sets are one class (size and two
64-bit sums over the set) and are joined once, as their smallest id. Let a be the least overlap that the
threshold leaves a set of n. In any order of shingles that all sets agree on, two linked sets share at least
K shingles of their first n - a + K, their K-prefixes.

1. *Which sets can link at all.* A set's shingles in order of their hashes: those of its K-prefix, K being
   a tenth of n, are dealt out by shingle, and a set stays if enough of them also occur in another document.
   A task settles shingles that its own documents share, and sends on one of each, so that a shingle of a
   third of all documents has a row for each task. Nothing is broadcast, and the shuffle grows with the text.
2. *Order by rarity.* Of the sets that stay, all shingles are counted among these sets. A set without a
   repeated shingles goes; the others take their shingles from rare to frequent (shared by more than
   ``frequent`` sets), then by hash.
3. *Index.* A set's prefix is extended: K is the least number, up to 16, for which its K-prefix holds fewer
   than K frequent shingles. Two linked sets then share a rare one in the shorter extension, so single rare
   shingles are indexed. Sets for which no such K exists are *heavy*: they index their rare shingles up to
   the largest K' of their size classes, and combinations of two frequent ones: shingles are dealt into
   K' - 1 groups by hash, where K' depends on the size class, so that of K' shared ones two are of one group.
4. *Verification.* Members of an index entry aren't all paired. First every set is compared with one entry's
   first document, then with the first ones it is still apart from; components are formed in between. Of
   entries that hold several components, the pairs between these follow: for a rare shingle, held by at most
   ``frequent`` sets, as pairs; for combinations in blocks of 512 sets by blocks of other components.
   The length bound holds everywhere, and links are whole sets' exact overlaps.

Defined results: a null or empty text, or one without words, has an empty set and links with nothing; a text
with fewer words than a shingle has one shingle, its whole sequence; rows with a null id get a row with a null
component; rows that repeat an id get a row each, by their own texts (they link only if their texts do), with
the smallest id reachable as component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import components, drop, save
from ._text import U64, WHITE_SEP, Slice, lists, mix, sequence_hashes, signed, slices, windows

if TYPE_CHECKING:
    import pandas as pd  # executors load it only where a step needs it

EXTEND = 16
BLOCK = 512
#: Prefix shingles that a task holds before it looks for those that its own documents share.
HELD = 500_000
ENTRY = ["kind", "k1", "k2"]
#: Kinds of index entries besides size classes, which are those of combinations.
SINGLE, TINY = -1, -2


class Threshold:
    """Exact integer forms of Jaccard >= t."""

    def __init__(self, t: Fraction):
        if not Fraction(1, 3) < t <= 1:
            raise ValueError("the threshold must lie above 1/3, and at 1 at most")
        self.t = t

    def least(self, n: int) -> int:
        """Overlap that a set of n needs with any partner."""
        return -(-self.t.numerator * n // self.t.denominator)

    def need(self, n, m):
        """Overlap that sets of n and m need: the least o with o >= t (n + m - o)."""
        top, bottom = self.t.numerator, self.t.numerator + self.t.denominator
        return -((-top * (n + m)) // bottom)

    def spare(self, n: int) -> int:
        """How far the indexed prefix reaches beyond n - least(n)."""
        return max(EXTEND, n * 7 // 100)

    def first(self, n: int) -> int:
        """The K of the prefix in which step 1 looks for shared shingles."""
        return min(max(EXTEND, n // 10), self.least(n))

    def shared(self, n: int) -> int:
        """Shingles of that prefix that a set of n shares with any partner, who may be smaller and so have a smaller K."""
        return self.first(self.least(n))


def shingle_sets(s: Slice, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted distinct shingle hashes (int64) of each text, and the numbers of words."""
    starts, ends, first = s.tokens(WHITE_SEP)
    words = s.hashes(starts, ends, lower=True)
    count = np.diff(first)
    every = signed(windows(words, k))
    whole = signed(sequence_hashes(words, first))
    out = []
    for i, (a, n) in enumerate(zip(first.tolist(), count.tolist())):
        out.append(np.unique(every[a : a + n - k + 1]) if n >= k else whole[i : i + (n > 0)])
    return out, count


def _sizes(docs: DataFrame, k: int) -> DataFrame:
    """(id, n) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, s in slices(batches):
            yield pa.RecordBatch.from_arrays([s.ids, pa.array([len(x) for x in shingle_sets(s, k)[0]], pa.int64())], ["id", "n"])

    return docs.mapInArrow(run, "id long, n long")


def _documents(docs: DataFrame, k: int, limit: Threshold) -> DataFrame:
    """(id, n, d1, d2, hits): of each document its set's size and digests, and how many shingles of its first prefix are shared."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def flush() -> Iterator[pa.RecordBatch]:
            ids, info, reach, flat = (np.concatenate(x) for x in zip(*held))
            held.clear()
            doc = np.repeat(np.arange(len(ids)), reach)
            order = np.argsort(flat, kind="stable")
            flat, doc = flat[order], doc[order]
            new = np.ones(len(flat), bool)
            new[1:] = flat[1:] != flat[:-1]
            begin = np.flatnonzero(new)
            many = np.diff(np.append(begin, len(flat)))
            hits = np.bincount(doc[np.repeat(many, many) > 1], minlength=len(ids))
            one, several = begin[many == 1], begin[many > 1]
            # Rows of three kinds: a document; a shingle settled here (empty info); a shingle that one document here has.
            raw = np.column_stack([info, hits]).astype("<i8").tobytes()
            rows = [raw[32 * i : 32 * i + 32] for i in range(len(ids))] + [b""] * len(several) + [None] * len(one)
            key = np.concatenate([signed(mix(ids.view(U64) + U64(1))), flat[several], flat[one]])
            yield from pa.Table.from_arrays([pa.array(key), pa.array(np.concatenate([ids, ids[doc[several]], ids[doc[one]]])), pa.array(rows, pa.binary())], ["token", "id", "info"]).to_batches(max_chunksize=1 << 16)

        for _, s in slices(batches):
            sets, _ = shingle_sets(s, k)
            n = np.array([len(x) for x in sets], np.int64)
            reach = np.array([m - limit.least(m) + limit.first(m) for m in n.tolist()], np.int64)
            d1 = np.array([x.sum() for x in sets], np.int64)
            d2 = np.array([mix(x.view(U64)).view(np.int64).sum() for x in sets], np.int64)
            held.append((s.ids.to_numpy(), np.column_stack([n, d1, d2]), reach, np.concatenate([x[:r] for x, r in zip(sets, reach.tolist())])))
            if sum(len(x[3]) for x in held) > HELD:
                yield from flush()
        if held:
            yield from flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by token. Gives each document's row, and (id, hits) of shared shingles not settled before."""
        last, alone = None, None  # the token of the row before; its document, if so far only one has it
        names = ["id", "n", "d1", "d2", "hits"]
        for batch in batches:
            sizes = np.diff(np.frombuffer(batch.column(2).buffers()[1], np.int32)[batch.column(2).offset : batch.column(2).offset + batch.num_rows + 1]) if batch.num_rows else np.zeros(0, np.int64)
            of_doc = sizes > 0
            info = np.frombuffer(b"".join(batch.column(2).filter(pa.array(of_doc)).to_pylist()), "<i8").reshape(-1, 4)
            doc_ids = batch.column(1).filter(pa.array(of_doc))
            yield pa.RecordBatch.from_arrays([doc_ids, *(pa.array(np.ascontiguousarray(info[:, i]), pa.int64()) for i in range(4))], names)
            token, ids = (batch.column(i).to_numpy()[~of_doc] for i in range(2))
            done = batch.column(2).is_valid().to_numpy(zero_copy_only=False)[~of_doc]  # settled by its task
            if not len(token):
                continue
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            begin = np.flatnonzero(new)
            many = np.diff(np.append(begin, len(token)))
            shared = (many > 1) | (np.add.reduceat(done, begin) > 0)
            late = []
            if last == token[0]:
                if alone is not None:
                    late.append(alone)
                shared[0] = True
            hit = ids[np.repeat(shared, many) & ~done]
            if not shared[-1]:
                last, alone = token[-1], ids[-1]
            else:
                last, alone = token[-1], None
            who, hits = np.unique(np.concatenate([hit, np.array(late, np.int64)]), return_counts=True)
            none = pa.nulls(len(who), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), none, none, none, pa.array(hits, pa.int64())], names)

    dealt = docs.mapInArrow(emit, "token long, id long, info binary").repartition("token").sortWithinPartitions("token")
    rows = dealt.mapInArrow(settle, "id long, n long, d1 long, d2 long, hits long")
    return rows.groupBy("id").agg(F.max("n").alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2"), F.sum("hits").alias("hits"))


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, n, shingles): the whole sets, as sorted 64-bit numbers, of the documents with these ids.

    A bitmap of the ids, of bounded size, lets most other documents be skipped before the join;
    texts are dealt out, which are smaller than sets.
    """
    size = 1 << 23
    cell = F.pmod(F.xxhash64("id"), F.lit(size)).cast("int")
    packed = np.zeros(size // 8, np.uint8)
    words = ids.select(cell.alias("c")).groupBy(F.shiftright("c", 5).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("c").bitwiseAND(31))).alias("b"))
    for part in words.collect():
        packed[part["w"] * 4 : part["w"] * 4 + 4] = np.frombuffer(int(part["b"]).to_bytes(4, "little"), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            c = batch.column(2).to_numpy()
            keep = pa.array((held[c >> 3] >> (c & 7).astype(np.uint8)) & 1 > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, s in slices(batches):
            sets, _ = shingle_sets(s, k)
            yield pa.RecordBatch.from_arrays([s.ids, pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "n", "shingles"])

    found = docs.withColumn("c", cell).mapInArrow(likely, "id long, text string")
    return found.join(ids, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(run, "id long, n long, shingles binary")


def _tokens(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The ids and sizes of some sets, and all their shingles."""
    for batch in _parts(batches, rows):
        if batch.num_rows:
            yield batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)


def _prefixes(sets: DataFrame, limit: Threshold, frequent: int) -> DataFrame:
    """(id, n, tokens, ranks, often) of the sets that can link: of the indexed prefix, in order of rarity, the shingles
    that several sets have, with their ranks and whether they are frequent."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for _, _, flat in _tokens(batches):
            held.append(flat)
            if sum(map(len, held)) > HELD:
                yield counted(held)
        if held:
            yield counted(held)

    def counted(held: list) -> pa.RecordBatch:
        token, many = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(many.astype(np.int32))], ["token", "m"])

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, n, flat in _tokens(batches, 64):
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(ids, n)), pa.array(np.repeat(n, n).astype(np.int32))], ["token", "id", "n"])

    counts = sets.mapInArrow(local, "token long, m int").groupBy("token").agg(F.sum("m").alias("df")).where("df > 1")
    counts = save(counts.select("token", F.least("df", F.lit(2**31 - 1)).cast("int").alias("df")), "counts")
    marked = sets.mapInArrow(apart, "token long, id long, n int").join(counts, "token")
    per = marked.groupBy("id", "n").agg(F.collect_list(F.struct("df", "token")).alias("x"))
    top, bottom = limit.t.numerator, limit.t.denominator
    per = per.where(F.size("x") >= F.expr(f"(n * {top}L + {bottom - 1}) div {bottom}"))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            if not batch.num_rows:
                continue
            x = batch.column(2)
            size = np.diff(x.offsets.to_numpy())
            df, token = (x.flatten().field(i).to_numpy() for i in range(2))
            n = batch.column(1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), size)
            by = np.lexsort((token, df, row))
            first = np.cumsum(size) - size
            rank = np.arange(len(df)) - first[row] + (n - size)[row]  # shingles of no other set come first
            keep = rank < np.array([m - limit.least(m) + limit.spare(m) for m in n.tolist()])[row]
            per = np.bincount(row[keep], minlength=len(n))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), lists(token[by][keep], per, pa.int64()), lists(rank[keep].astype(np.int32), per, pa.int32()), lists(df[by][keep] > frequent, per, pa.bool_())],
                ["id", "n", "tokens", "ranks", "often"],
            )

    return per.mapInArrow(order, "id long, n long, tokens array<long>, ranks array<int>, often array<boolean>")


def _entries(reps: DataFrame, limit: Threshold) -> DataFrame:
    """(kind, k1, k2, id, n) of the index: single rare shingles, combinations of frequent ones, and shingles of sets so small
    that one shared shingle links them with a set of one."""
    tiny = int(1 / limit.t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            out: list = [(np.zeros(0, np.int32), *(np.zeros(0, np.int64),) * 4)]

            def put(kind: int, one: np.ndarray, two: np.ndarray | None, i: int, n: int) -> None:
                out.append((np.full(len(one), kind, np.int32), one, np.zeros(len(one), np.int64) if two is None else two, np.full(len(one), i), np.full(len(one), n)))

            for i, n, tok, rank, often in zip(*(c.to_pylist() for c in batch.columns)):
                tok, rank, often = np.array(tok, np.int64), np.array(rank, np.int64), np.array(often, bool)
                cut, most = n - limit.least(n), min(EXTEND, limit.least(n))
                reach, heavy = extension(rank[often], cut, most)
                if heavy:
                    reach = max([reach, *(k for _, k in classes(n, limit))])
                    for cls, k in classes(n, limit):
                        use = tok[often & (rank < cut + k)]
                        group = (mix(use.view(U64)) % U64(k - 1)).astype(np.int64)
                        for g in np.unique(group):
                            own = np.sort(use[group == g])
                            a, b = np.triu_indices(len(own), 1)
                            put(cls, own[a], own[b], i, n)
                put(SINGLE, tok[~often & (rank < cut + reach)], None, i, n)
                if n <= tiny and tiny > 1:
                    put(TINY, tok, None, i, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], [*ENTRY, "id", "n"])

    return reps.mapInArrow(run, "kind int, k1 long, k2 long, id long, n long")


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The rows a few at a time: they become Python objects."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def extension(ranks: np.ndarray, cut: int, most: int) -> tuple[int, bool]:
    """The least K <= most whose K-prefix holds fewer than K of the frequent shingles at these ranks; else most, and True."""
    ranks = np.sort(ranks)
    for k in range(1, most + 1):
        if np.searchsorted(ranks, cut + k) < k:
            return k, False
    return most, True


def classes(n: int, limit: Threshold) -> list[tuple[int, int]]:
    """The size classes under which a set of n indexes combinations, each with the class's K.

    Sizes of linked sets differ by 1 / t at most, so they are of one class or of two neighbouring ones;
    each set is listed in its own class and in the one below, where its larger partners are not.
    """
    step = math.log(limit.t.denominator / limit.t.numerator)
    own = int(math.log(n) / step + 1e-9)
    out = []
    for cls in (own, own - 1):
        smallest = max(1, int(math.exp(cls * step)) - 1)  # of any set listed in the class
        out.append((cls, max(2, min(limit.least(smallest), limit.spare(smallest)))))
    return out


def like_sizes(n, m, limit: Threshold):
    """The length bound: sets of n and m can be similar."""
    return F.least(n, m) * limit.t.denominator >= F.greatest(n, m) * limit.t.numerator


def _verified(pairs: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar. Both joins are of plain tables, so that a document of very many pairs is split."""
    own = sets.select("id", "shingles")
    both = pairs.select("a", "b").join(own.toDF("b", "s_b"), "b").join(own.toDF("a", "s_a"), "a").select("a", "b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            last = held = None
            for x, y in zip(batch.column(2), batch.column(3)):
                if (data := x.as_buffer().to_pybytes()) != last:
                    last, held = data, np.frombuffer(data, np.int64)
                y = np.frombuffer(y.as_buffer(), np.int64)
                at = np.minimum(np.searchsorted(held, y), len(held) - 1)
                good.append(int((held[at] == y).sum()) >= limit.need(len(held), len(y)))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _block_links(apart: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """A spanning forest of the links between components that share combinations. apart: ENTRY, id, n, lead, c.

    Sets that entries connect form clusters. Within a cluster and size class a component of a block's size or more has
    blocks of its own, smaller ones share blocks; blocks meet, two at a time, unless both are of one component or their
    sizes differ too much.
    """
    step = math.log(limit.t.denominator / limit.t.numerator)
    edges = apart.where("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
    cluster = components(edges).withColumnRenamed("component_id", "cluster")
    cls = F.floor(F.log("n") / F.lit(step) + 1e-9).cast("int") if step else F.lit(0)
    member = save(apart.select("id", "n", "c").distinct().join(cluster, "id").withColumn("cls", cls), "clusters")
    sizes = member.groupBy("cluster", "cls", "c").agg(F.count("*").alias("m"))
    large = F.when(F.col("m") >= BLOCK, F.col("c"))
    shape = save(sizes.select("cluster", "cls", "c", "m", large.alias("own")), "component_sizes")
    blocks = shape.groupBy("cluster", "cls", "own").agg(F.ceil(F.sum("m") / BLOCK).cast("int").alias("parts"))
    name = lambda own, part: F.xxhash64("cluster", "cls", own.isNull(), own, part)
    member = member.join(shape.select("cluster", "cls", "c", "own"), ["cluster", "cls", "c"])
    member = member.join(blocks.withColumnRenamed("own", "o"), (member["cluster"] == blocks["cluster"]) & (member["cls"] == blocks["cls"]) & member["own"].eqNullSafe(F.col("o"))).select(member["cluster"], member["cls"], "own", "id", "c", "parts")
    member = member.withColumn("part", F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("c")).otherwise(F.col("id"))), F.col("parts")).cast("int"))
    member = save(member.select("cluster", "cls", "own", "id", "c", name(F.col("own"), F.col("part")).alias("block")), "members")
    every = save(member.select("cluster", "cls", "own", "block").distinct(), "blocks")
    one, two = every.toDF("cluster", "c1", "o1", "low"), every.toDF("cluster", "c2", "o2", "high")
    meet = one.join(two, "cluster").where("low <= high and abs(c1 - c2) <= 1 and not (o1 is not null and o1 <=> o2)").select("low", "high")
    meet = save(meet, "meet")
    sides = meet.select("low", "high", F.col("low").alias("block")).unionByName(meet.where("low <> high").select("low", "high", F.col("high").alias("block")))
    spread = member.select("id", "c", "block").join(sides, "block").join(sets.select("id", "shingles"), "id")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _compare(pdf, limit)

    return spread.groupBy("low", "high").applyInPandas(compare, "a long, b long")


def _compare(pdf: pd.DataFrame, limit: Threshold) -> pd.DataFrame:
    """A spanning forest of the links between sets of different components."""
    pdf = pdf.sort_values("id", ignore_index=True)
    sets = [np.frombuffer(x, np.int64) for x in pdf["shingles"]]
    size, group = np.array([len(x) for x in sets]), pdf["c"].to_numpy()
    vocabulary, column = np.unique(np.concatenate(sets), return_inverse=True)
    m, ids = len(sets), pdf["id"].to_numpy()
    row = np.repeat(np.arange(m), size)
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    overlap = np.zeros((m, m), np.float32)
    for k in range(0, len(vocabulary), 2048):
        a, b = np.searchsorted(column, (k, k + 2048))
        x = np.zeros((m, min(2048, len(vocabulary) - k)), np.float32)
        x[row[a:b], column[a:b] - k] = 1
        overlap += x @ x.T
    linked = (overlap >= limit.need(size[:, None], size[None, :])) & (group[:, None] != group[None, :])
    seen, out = np.zeros(m, bool), []
    for start in range(m):
        if seen[start]:
            continue
        seen[start] = True
        stack = [start]
        while stack:
            i = stack.pop()
            new = np.flatnonzero(linked[i] & ~seen)
            seen[new] = True
            stack += new.tolist()
            out += [(ids[j], ids[i]) for j in new.tolist()]
    import pandas as pd

    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _links(entries: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """Links (a, b) between sets whose components are those of all links. entries: ENTRY, id, n."""
    lead = F.min(F.struct(F.when(F.col("kind") == TINY, F.col("n")).otherwise(0).alias("o"), "id", "n"))
    leads = entries.groupBy(*ENTRY).agg(lead.alias("lead"), F.count("*").alias("m")).where("m > 1")
    leads = save(leads.select(*ENTRY, F.col("lead.id").alias("lead"), F.col("lead.n").alias("lead_n")), "leads")
    members = save(entries.join(leads, ENTRY), "members")
    star = members.where("id <> lead").where(like_sizes("n", "lead_n", limit)).select(F.col("lead").alias("a"), F.col("id").alias("b"))
    once = save(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "once")
    links = save(_verified(once, sets, limit), "links")

    def placed(rows: DataFrame, group: DataFrame) -> DataFrame:
        here = rows.join(group, "id", "left").withColumn("c", F.coalesce("component_id", "id")).drop("component_id")
        return here

    group = save(components(links), "groups")
    root = lambda rows, x: rows.join(group.toDF(x, f"c_{x}"), x, "left").withColumn(f"c_{x}", F.coalesce(f"c_{x}", x))
    again = root(root(star.distinct(), "a"), "b").where("c_a <> c_b").select("a", "b").join(once, ["a", "b"], "left_anti")
    again = save(again, "again")
    if not again.isEmpty():
        links = save(links.unionByName(_verified(again, sets, limit)), "links")
        group = save(components(links), "groups")

    # Entries whose sets are still apart: the pairs between components.
    here = placed(members.where(F.col("kind") != TINY), group)
    here = save(here, "placed")
    apart = here.groupBy(*ENTRY).agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("m")).where("c1 <> c2 and (m > 2 or kind <> -1)").select(*ENTRY)
    left = save(here.join(apart, ENTRY), "apart")
    single = left.where(F.col("kind") == SINGLE)
    two = single.select("k1", F.col("id").alias("b"), F.col("n").alias("m"), F.col("c").alias("cb"))
    rest = single.select("k1", F.col("id").alias("a"), "n", F.col("c").alias("ca")).join(two, "k1").where("a < b and ca <> cb").where(like_sizes("n", "m", limit)).select("a", "b").distinct()
    tried = once.unionByName(again)
    rest = save(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    more = [] if rest.isEmpty() else [_verified(rest, sets, limit)]
    combined = left.where(F.col("kind") >= 0)
    if not combined.isEmpty():
        more.append(_block_links(combined, sets, limit))
    for x in more:
        links = links.unionByName(x)
    links = save(links, "links")
    drop(leads, members, here, left)
    return links


def similar_groups(df: DataFrame, threshold: str = "0.8", shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", frequent: int = 64) -> DataFrame:
    """(id, n_shingles, component_id) of each row; component_id is the smallest id reachable by links."""
    limit = Threshold(Fraction(threshold))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known, nameless = docs.where("id is not null"), docs.where("id is null")
    repeats = not known.groupBy("id").count().where("count > 1").isEmpty()
    if repeats:  # rows of one id are told apart by their texts
        known = known.select("id", F.xxhash64("id", F.col("text").isNull(), "text").alias("key"), "text")
        names, known = save(known.select("id", "key"), "keys"), known.select(F.col("key").alias("id"), "text")

    rows = save(_documents(known, shingle, limit), "documents")
    same = save(rows.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.max("hits").alias("hits")), "classes")
    top, bottom = limit.t.numerator, limit.t.denominator
    least = lambda n: f"(({n}) * {top}L + {bottom - 1}) div {bottom}"
    first = f"least(greatest({EXTEND}, ({least('n')}) div 10), {least(least('n'))})"  # Threshold.shared
    ids = save(same.where(f"hits >= {first}").select(F.col("rep").alias("id")), "likely")
    sets = save(_sets(known, ids, shingle), "sets")
    prefixes = save(_prefixes(sets, limit, frequent), "prefixes")
    entries = save(_entries(prefixes, limit), "entries")
    group = save(components(_links(entries, sets, limit)), "groups")
    drop(sets, prefixes, entries, ids)

    # From classes back to rows.
    per = same.join(group.select(F.col("id").alias("rep"), "component_id"), "rep", "left").select("n", "d1", "d2", F.coalesce("component_id", "rep").alias("component_id"))
    found = rows.where("n > 0").join(per, ["n", "d1", "d2"]).select("id", "n", "component_id").unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    if repeats:
        found = save(names.join(found.withColumnRenamed("id", "key"), "key"), "named")
        lowest = found.where("n > 0").groupBy("component_id").agg(F.min("id").alias("lowest"))
        found = found.join(lowest, "component_id", "left").select("id", "n", F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("id")).alias("component_id"))
    others = _sizes(nameless, shingle).select("id", "n", F.lit(None).cast("long").alias("component_id"))
    return found.unionByName(others).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def oracle() -> str:
    """DuckDB SQL for op7's rows, from all pairs that share a shingle; for small tables."""
    return r"""
    WITH RECURSIVE d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
    r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
    SELECT r.a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a"""
