"""Awkward cases of the training-data operators: repeated ids, colliding names, very long texts, structured words, skew."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomix.llm import _text, decontaminate, embeddings, jaccard, language, line_dedup, pieces, quality, sharding, substring, token_files
from loomix.llm.registry import tokenizer_path

from .test_operators import alnum, lower, reach


def thue_morse(n, a="a", b="b"):
    text = a
    while len(text) < n:
        text += text.translate(str.maketrans(a + b, b + a))
    return text[:n]


ONE, TWO = thue_morse(1024), thue_morse(1024, "b", "a")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def slice_of(texts):
    return next(_text.slices(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])])))[1]


def test_hashes_tell_structured_words_apart():
    s = slice_of([ONE, TWO, ONE.upper(), "ab", "abababab", "ababababa", "b" * 9])
    starts, ends, _ = s.tokens(_text.WHITE_SEP)
    plain = s.hashes(starts, ends)
    assert len(set(plain.tolist())) == 7
    folded = s.hashes(starts, ends, lower=True)
    assert folded[0] == folded[2] and len(set(folded.tolist())) == 6
    assert not set(plain.tolist()) & set(s.hashes(starts, ends, seed=12).tolist())
    words = np.array([1, 2] * 20, np.uint64)
    for k in range(1, 20):
        runs = _text.windows(words, k)
        assert len(runs) == 41 - k and len(set(runs.tolist())) == 2


def test_structured_words_in_every_operator(spark):
    """Two words that collide under every polynomial hash modulo 2**64."""
    path = tokenizer_path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    rows = frame(spark, [(0, ONE), (1, TWO), (2, f"{ONE} {TWO}"), (3, f"{TWO} {ONE}")])
    got = {r.doc_id: r.ids for r in token_files.token_files(rows, path).collect()}
    text = {r.doc_id: r.text for r in rows.collect()}
    assert got == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in text.items()}
    assert len({tuple(r.ids) for r in pieces.encode(rows, tokenizer_path("piece_bpe_32k.model"), dropout=0).collect()}) == 4
    lines = frame(spark, [(i, ONE) for i in range(4)] + [(4, TWO)])
    assert {r.n_dropped for r in line_dedup.dedup_lines(lines).collect()} == {0}
    runs = frame(spark, [(i, " ".join([w] * 3)) for i, w in enumerate((ONE, TWO))])
    assert {r.n_removed for r in substring.dedup_substrings(runs, window=3).collect()} == {0}
    assert {r.component_id for r in jaccard.similar_groups(runs, shingle=2).collect()} == {0, 1}
    items = spark.createDataFrame([("a", TWO)], "item_id string, text string")
    found = {r.doc_id: list(r["items"]) for r in decontaminate.decontaminate(rows, items, ["doc_id"]).collect()}
    assert found == {0: [], 1: ["a"], 2: ["a"], 3: ["a"]}


def test_caches_compare_bytes(monkeypatch):
    """With hashes of six bits nearly every lookup finds something else."""
    plain = _text.Slice.hashes
    monkeypatch.setattr(_text.Slice, "hashes", lambda self, *a, **k: plain(self, *a, **k) & np.uint64(63))
    from tokenizers import Tokenizer

    from loomix.llm import _bpe

    path, rng = tokenizer_path("byte_bpe_50k.json"), random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdeü") for _ in range(rng.randint(1, 9))) for _ in range(60)) for _ in range(20)]
    encoder, tokenizer = _bpe.Encoder(path), Tokenizer.from_file(path)
    own, plain_own = pieces.Encoder(tokenizer_path("piece_bpe_32k.model")), __import__("sentencepiece").SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for part in (texts[:10], texts[10:], texts):
        ids, counts = encoder.encode(slice_of(part))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]
        ids, counts = own.encode(slice_of(part))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain_own.encode(t) for t in part]


def test_tokenizer_of_another_kind_gets_whole_texts(tmp_path):
    from tokenizers import Tokenizer, normalizers

    from loomix.llm import _bpe

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    tokenizer.normalizer = normalizers.Lowercase()
    tokenizer.save(path := str(tmp_path / "lower.json"))
    texts = ["Some WORDS here", "", "MORE\nLines  X", "ÄÖ"]
    ids, counts = _bpe.Encoder(path).encode(slice_of(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_lines_of_repeated_ids_count_once(spark):
    line = "a line that is long enough to be counted as a key"
    rows = [(1, line), (1, line), (1, f"other\n{line}"), (1, line), (2, line), (None, line)]
    assert all(r.n_dropped == 0 for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    rows += [(i, line) for i in (3, 4, 5)]
    got = sorted((r.doc_id, r.n_dropped) for r in line_dedup.dedup_lines(frame(spark, rows)).where("doc_id is not null").collect())
    assert got == [(1, 1)] * 4 + [(2, 1), (3, 1), (4, 1), (5, 0)]
    index = line_dedup.LineIndex(spark).insert(frame(spark, rows[:5])).insert(frame(spark, rows[6:])).insert(frame(spark, [(5, line)]))
    assert {r.n_dropped for r in index.dedup(frame(spark, rows[6:8])).collect()} == {1}
    index.delete(frame(spark, [(5, line)]))
    assert {(r.doc_id, r.n_dropped) for r in index.dedup(frame(spark, rows[6:])).collect()} == {(3, 1), (4, 1), (5, 0)}  # inserted twice, deleted once
    index.delete(frame(spark, [(5, line)]))
    assert {r.n_dropped for r in index.dedup(frame(spark, rows[6:])).collect()} == {0}  # four documents


def test_line_index_grows_reopens_and_finds_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PER_SHARD", 8)
    monkeypatch.setattr(line_dedup, "HOT", 16)
    common, key = "the most common line of them all, in every document", lambda k: f"line number {k} of those that several documents have"
    text = {i: "\n".join([common, *(key(k) for k in range(60) if (i * 7 + k) % 9 == 0), f"only {i}"]) for i in range(80)}
    rows = lambda ids: frame(spark, [(i, text[i]) for i in ids])

    def brute(ids):
        held = {}
        for i in ids:
            for x in text[i].split("\n"):
                if len(x) >= 40:
                    held.setdefault(x, set()).add(i)
        return {i: "\n".join(x for x in text[i].split("\n") if not (len(x) >= 40 and len(held[x]) >= 5 and max(held[x]) != i)) for i in ids}

    see = lambda index, ids: {r.doc_id: r.text for r in index.dedup(rows(ids)).collect()}
    index = line_dedup.LineIndex(spark, shards=2).insert(rows(range(10)))
    small = index.shards
    assert see(index, range(10)) == brute(range(10))
    index.insert(rows(range(10, 80)))
    assert index.shards > 2 * small and see(index, range(80)) == brute(range(80))
    index.delete(rows(range(70, 80)))
    again = line_dedup.LineIndex.open(spark, index.path)
    assert (again.version, again.shards) == (3, index.shards) and see(again, range(70)) == brute(range(70))
    again.insert(rows(range(75, 80)))
    ids = [*range(70), *range(75, 80)]
    assert see(line_dedup.LineIndex.open(spark, index.path), ids) == brute(ids)


def test_sharding_holds_its_limit_for_one_key(spark):
    rows = spark.range(200_000).select(F.when(F.col("id") % 4 > 0, 1).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("x" * 40), (F.col("id") % 3).cast("string")).alias("text"))
    got = sharding.assign_shards(rows, 5000)
    sums = got.groupBy("shard", "shard_bytes", "shard_docs").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in sums) == 200_000 and all(r.b == r.shard_bytes <= 5000 and r.n == r.shard_docs for r in sums)
    again = sharding.assign_shards(rows.repartition(7), 5000)
    see = lambda df: sorted(map(tuple, df.groupBy("doc_id", "shard", "n_bytes").count().collect()))
    assert see(again) == see(got)  # whatever the partitioning
    assert len({r.shard for r in sums}) == len(sums)


def test_sharding_of_very_long_and_null(spark):
    rows = spark.createDataFrame([(1, "y" * 2_000_000), (2, None), (None, "z"), (None, "z"), (3, "")], "doc_id long, text string")
    got = sharding.assign_shards(rows, 1000).collect()
    assert len(got) == 5 and [(r.doc_id, r.shard_docs) for r in got if r.oversized] == [(1, 1)]


def test_jaccard_short_documents_of_one_shared_shingle(spark):
    """Only few candidates come of a shingle that all documents have."""
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d x"), "id", F.lit(" y"), "id").alias("text"))
    limit = jaccard.Threshold(jaccard.Fraction("0.85"))
    docs = rows.toDF("id", "text")
    sets = jaccard._sets(docs, docs.select("id"), 4).cache()
    entries = jaccard._entries(jaccard._prefixes(sets, limit, 64), limit)
    assert entries.count() <= 4 * 4000
    assert entries.groupBy(*jaccard.ENTRY).count().where("count > 64").count() == 0
    got = jaccard.similar_groups(rows, "0.85", 4)
    assert got.where("component_id <> doc_id").count() == 0 and got.count() == 4000


def test_jaccard_templates_and_families(spark, monkeypatch):
    """Families over one template, some at the edge of the threshold, and documents that only share the template."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(11)
    template = [f"t{k}" for k in range(80)]
    rows = []
    for family in range(5):
        own = [f"f{family}w{k}" for k in range(40)]
        for _ in range(25):
            w = template + own
            for k in rng.sample(range(120), rng.randint(0, 5)):
                w = [*w[:k], f"x{rng.randint(0, 2)}", *w[k + 1 :]]
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join(template[: 60 + i % 20])) for i in range(30)]
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in rows}
    links = {i: {j for j in sets if j != i and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])} for i in sets}
    for frequent in (3, 20):
        got = {r.doc_id: r.component_id for r in jaccard.similar_groups(frame(spark, rows), "0.85", 4, frequent=frequent).collect()}
        assert got == {i: min(reach(i, links)) for i in sets}


def test_repeated_ids_with_other_texts(spark):
    text, near = " ".join(f"w{k}" for k in range(60)), " ".join([*(f"w{k}" for k in range(59)), "z"])
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(7, text), (7, other), (7, other), (3, near), (9, other), (5, "x"), (5, "x"), (None, text)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(7, 56, 3), (7, 56, 7), (7, 56, 7), (3, 56, 3), (9, 56, 7), (5, 1, 5), (5, 1, 5), (None, 56, None)], key=str)
    got = sorted(((r.doc_id, r.n_removed) for r in substring.dedup_substrings(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(7, 0), (7, 0), (7, 0), (9, 60), (3, 0), (5, 0), (5, 0), (None, 0)] , key=str) or dict(got)[9] == 60
    items = spark.createDataFrame([(1, text[:100]), (1, other), (2, other)], "item_id long, text string")
    got = sorted((str(r.doc_id), tuple(r["items"])) for r in decontaminate.decontaminate(frame(spark, rows), items, ["doc_id"]).collect())
    assert got == sorted([("7", ("1",)), ("7", ("1", "2")), ("7", ("1", "2")), ("3", ("1",)), ("9", ("1", "2")), ("5", ()), ("5", ()), ("None", ("1",))])
    path = tokenizer_path("byte_bpe_50k.json")
    see = lambda n: sorted(map(tuple, token_files.token_files(frame(spark, rows).repartition(n), path, with_ids=False).collect()), key=str)
    assert see(1) == see(5) and len(see(2)) == len(rows)
    assert {r.lang_pred for r in language.identify(frame(spark, rows).withColumn("lang", F.lit("en"))).collect()} == {"en"}
    labels = spark.createDataFrame([(7, 1), (7, 0), (3, 1), (5, 0), (9, 1), (9, 1)], "doc_id long, quality int")
    assert quality.classify(frame(spark, rows), labels).count() == len(rows)


def test_very_long_texts_and_clashing_columns(spark):
    """A text above the size of a slice, and other columns named like results, ids and helpers."""
    long = " ".join(f"word{k % 5003}" for k in range(120_000)) + "\n" + "the last line is long enough to count as a key"
    names = ["id", "key", "c", "token", "n_words", "items", "spans", "score", "lang_pred", "n_lines", "ids", "shard", "label2"]
    rows = frame(spark, [(0, long), (1, long), (2, "short text here"), (3, ""), (4, None)])
    rows = rows.withColumns({n: F.lit(f"own {n}") for n in names}).withColumn("lang", F.lit("en"))
    assert len(long) > _text.SLICE_BYTES
    own = substring.dedup_substrings(rows, keep=["doc_id", "text", "n_words"])
    assert own.columns == ["doc_id", "text", "n_words", "kept_text", "kept_n_words", "n_removed"]
    assert {r.doc_id: r.n_removed for r in own.collect()}[1] == 120_011 and own.count() == 5
    own = decontaminate.decontaminate(rows, spark.createDataFrame([(1, "short text")], "item_id long, text string"), ["doc_id", "items", "spans"])
    assert own.columns == ["doc_id", "items", "spans", "n_words", "kept_spans", "kept_items"] and own.where("size(kept_items) = 1").count() == 1
    own = line_dedup.dedup_lines(rows, keep=["doc_id", "n_lines"])
    assert own.columns == ["doc_id", "n_lines", "text", "kept_n_lines", "n_dropped"] and own.where("n_dropped = 0").count() == 5
    assert {r.doc_id: r.component_id for r in jaccard.similar_groups(rows).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    assert language.predict(rows, language.train(rows), ["doc_id", "score", "lang_pred"]).columns == ["doc_id", "score", "lang_pred", "kept_lang_pred", "kept_score"]
    assert {r.lang_pred for r in language.identify(rows).where("doc_id < 3").collect()} == {"en"}
    assert quality.score(rows, None, ["doc_id", "score"]).columns == ["doc_id", "score", "kept_score"]
    path = tokenizer_path("piece_bpe_32k.model")
    back = pieces.decode(pieces.encode(rows, path).join(rows, "doc_id").drop("ids").withColumnRenamed("text", "kept").join(pieces.encode(rows, path), "doc_id"), path, ["doc_id", "kept", "key"])
    assert back.columns == ["doc_id", "kept", "key", "text"] and back.where("text <> coalesce(kept, '')").count() == 0
    assert pieces.decode(pieces.encode(rows, path).withColumn("text", F.lit(1)), path, ["text"]).columns == ["text", "kept_text"]
    assert all(r.lossless for r in pieces.round_trip(rows, path, dropout=0.2, seed=3).collect())
    assert token_files.token_files(rows, tokenizer_path("byte_bpe_50k.json"), with_ids=False).count() == 5
    assert sharding.assign_shards(rows, 100).count() == 5


def test_embeddings_of_null_and_repeated_ids(spark):
    """Null and repeated ids, ties of equal vectors, colliding names; also when some pairs miss the first projections' windows."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal(24).tolist()
    near = [x + 0.01 for x in base]
    rows = [(None, base, "a", "x"), (1, base, "a", "x"), (1, near, "a", "x"), (2, base, "a", "x"), (3, rng.standard_normal(24).tolist(), "a", "x"), (4, base, None, "x"), (5, base, "b", "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, id string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 0, None, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)], key=str)


def test_embeddings_recall_at_the_threshold(spark):
    """Pairs just above the threshold are found, those below aren't."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(400):
        a, b = rng.standard_normal((2, 48))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = 0.9301 if k % 2 else 0.9299
        rows += [(2 * k, a.tolist(), 0), (2 * k + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), 0)]
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=64).collect()}
    assert sum(got[4 * k + 2] for k in range(200)) >= 199 and sum(got[4 * k] for k in range(200)) == 0


def plain_agenda(model, word, key, skip):
    """Merges one word's symbols by the agenda; key: the word's hash, or None. Candidates are skipped by their extent's hash."""
    m64, mask = _mix, (1 << 64) - 1
    parts = [(model.single[ord(c)], i, i + 1) for i, c in enumerate(word)]
    decided = {}
    while True:
        best = None
        for i, ((x, a, b), (y, _, c)) in enumerate(zip(parts, parts[1:])):
            joined = int(model.merge(np.array([x]), np.array([y]))[0])
            if joined >= 0 and (a, b, c) not in decided:
                h = m64((key + (a * 0x10001 + b) * 0x100000001 + c * 0x9E3779B97F4A7C15) & mask) >> 32
                decided[a, b, c] = h < skip
            if joined >= 0 and not decided[a, b, c]:
                best = min(best or (1 << 60, 0, 0), (int(model.rank[joined]), i, joined))
        if best is None:
            return [int(x) for x, _, _ in parts]
        _, i, joined = best
        parts[i : i + 2] = [(joined, parts[i][1], parts[i + 1][2])]


def _mix(h):
    mask = (1 << 64) - 1
    h ^= h >> 31
    h = h * 0x7FB5D329728EA185 & mask
    h ^= h >> 27
    h = h * 0x81DADEF4BC2DD44D & mask
    return h ^ h >> 33


def plain_ids(model, doc_id, text, dropout, seed):
    """The ids of a text of ASCII words and single blanks, from word to word."""
    mask = (1 << 64) - 1
    own = _mix((_mix((doc_id + 0xBF58476D1CE4E5B9) & mask) + (seed * 0xD1342543DE82EF95)) & mask)
    out, at = [], 0
    for k, word in enumerate(text.split(" ") if text else []):
        begin = at if k == 0 else at - 1
        key = _mix((own + begin * 0xA24BAED4963EE407) & mask)
        out += plain_agenda(model, "▁" + word, _mix(key), int(dropout * 2**32))
        at += len(word) + 1
    return out


def test_dropout_equals_a_plain_agenda(spark):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 20, 70]))) for _ in range(30)) for _ in range(8)]
    path = tokenizer_path("piece_bpe_32k.model")
    model = pieces.PieceModel(path)
    got = {r.doc_id: r.ids for r in pieces.encode(frame(spark, list(enumerate(texts))), path, dropout=0.25, seed=6).collect()}
    assert got == {i: plain_ids(model, i, t, 0.25, 6) for i, t in enumerate(texts)}


def test_language_equals_a_plain_prediction(spark):
    rng = random.Random(12)
    vocabulary = {"en": "the of and with that this".split(), "de": "der und nicht mit eine schön".split(), "nl": "het een niet voor maar zijn".split(), "fr": "le avec être même pour vous".split()}
    rows = [(i, " ".join(rng.choice(vocabulary[c]) for _ in range(rng.randint(3, 12))), c) for i, c in ((i, rng.choice(list(vocabulary))) for i in range(240))]
    df = spark.createDataFrame([*rows, (900, "Der, UND? 12", None), (901, "12 ..", None)], "doc_id long, text string, lang string")
    model = language.train(df.where(~language.held_out()))
    dimensions = language.DIMENSIONS

    def vector(text):
        data = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]
        x = np.zeros(dimensions)
        for width in range(1, 5):
            for k in range(len(data) - width + 1):
                key = int.from_bytes(bytes(data[k : k + width]), "big")
                if any(b != 32 for b in data[k : k + width]):
                    x[(_mix(key + (width << 40)) >> 40) % dimensions] += 1
        x = np.sqrt(x)
        return np.append(x / max(np.linalg.norm(x), 1e-9), 1)

    link = lambda m: 1 / (1 + np.exp(-4 * m))
    got = {r.doc_id: r for r in language.identify(df).collect()}
    for i, text, _ in rows:
        x = vector(text)
        margins = model.family_w @ x
        family = list(model.families)[int(margins.argmax())]
        codes, wins, least = model.families[family], {}, {}
        for a, b in itertools.combinations(codes, 2):
            m = float(model.pair_w[family, a, b] @ x)
            for code, own in ((a, m), (b, -m)):
                wins[code] = wins.get(code, 0) + (own > 0) + 1e-3 * np.tanh(own)
                least[code] = min(least.get(code, np.inf), own)
        want = max(codes, key=lambda c: wins.get(c, 0))
        score = link(margins.max()) * (link(least[want]) if len(codes) > 1 else 1)
        assert got[i].lang_pred == want and abs(got[i].score - score) < 1e-3
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert got[900].lang_pred in vocabulary and got[901].lang_pred == "und"


def test_quality_equals_enumeration(spark):
    """From features to score and prediction: each document alone, its labelings enumerated."""
    rng = random.Random(8)
    line = lambda good: " ".join(rng.choice(["the", "House", "was", "built.", "of"]) if good else rng.choice(["$$", "12|", "!!", "x"]) for _ in range(rng.randint(1, 9)))
    rows = [(i, "\n".join(line(rng.random() < (0.9 if i % 2 else 0.2)) for _ in range(rng.randint(1, 7)))) for i in range(160)] + [(500, ""), (501, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id long, quality int")
    model = quality.train(df, labels.where(~quality.held_out()))
    got = {r.doc_id: r for r in quality.classify(df, labels).collect()}
    for i, text in rows:
        x, weight, _ = quality.line_features(slice_of([text or ""]))
        assert weight.tolist() == [len(part.encode()) + 1 for part in (text or "").split("\n")]
        unary = ((x - model.mean) / model.scale) @ model.w
        total, good = 0.0, np.zeros(len(unary))
        for y in itertools.product((0, 1), repeat=len(unary)):
            p = np.exp(sum(u for u, v in zip(unary, y) if v) + sum(model.trans[a, b] for a, b in zip(y, y[1:])))
            total += p
            good += p * np.array(y)
        want = float((good / total * weight).sum() / weight.sum())
        assert abs(got[i].score - want) < 1e-5 and got[i].predicted == int(got[i].score >= 0.7)


def test_quality_bounds_lines_before_the_driver(spark):
    rows = [(i, "\n".join(["a line"] * (3 + i))) for i in range(40)] + [(100, "\n" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    assert quality.train(df, labels, max_lines=50) is not None
    assert quality.train(df, labels.where("doc_id = 100"), max_lines=50) is None


def test_pipeline_equals_brute_force(spark, tmp_path, monkeypatch):
    """All five stages over a small table with nulls, copies, repeated lines, benchmark passages and repeated ids."""
    import corpus_pipeline

    rng = random.Random(21)
    vocabulary = {"en": ["the", "house", "river", "with", "stone", "under", "light", "carry"], "de": ["der", "fluss", "nicht", "haus", "unter", "licht", "tragen", "stein"]}
    say = lambda c, n: " ".join(rng.choice(vocabulary[c]) + rng.choice(["", "", "s", "en"]) for _ in range(n))
    shared, item = "this line of the licence is repeated in many documents of the table", " ".join(f"item{k} exam" for k in range(8))
    rows = []
    for i in range(60):
        c = "en" if i % 2 else "de"
        text = say(c, 40)
        if i % 5 == 0:
            text += f"\n  {shared.upper() if i % 2 else shared} "
        if i in (7, 8):
            text += f" {item[20:90]} end"
        rows.append([i, text, c if i % 7 else None, "web", len(text)])
    rows += [[100, rows[1][1], "en", "web", 1], [101, rows[1][1] + " more", "en", "web", 1], [102, None, "en", None, None], [103, "12 34", "en", "web", 5], [104, "", None, "web", 0], [None, rows[3][1], "en", "web", 3], [105, "word " * 40, "en", "web", 3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench = [(1, item), (2, None), (3, "too"), (3, "exam item9")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    predicted = {(r.doc_id, r.text): r.lang for r in corpus_pipeline.language_stage(spark, docs, str(tmp_path)).collect()}
    kept = [(i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)]
    assert sorted(predicted, key=str) == sorted(kept, key=str) and set(predicted.values()) <= {"en", "de"}

    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in kept:
        for x in t.split("\n"):
            if i is not None and len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(i)
    lost = lambda i, x: i is not None and len(held.get(key(x), ())) >= 5 and max(held[key(x)]) != i
    kept = [(i, "\n".join(x for x in t.split("\n") if not lost(i, x))) for i, t in kept]

    def shingles(t):
        w = lower(t).encode().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in kept if i is not None}
    links = {i: {j for j in sets if i != j and sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])} for i in sets}
    kept = [(i, t) for i, t in kept if i is None or min(reach(i, links)) == i]

    def hit(t):
        w = alnum(t)
        for _, x in bench:
            v = alnum(x)
            n = min(10, len(v))
            if n and any(v[k : k + n] == w[p : p + n] for k in range(len(v) - n + 1) for p in range(len(w) - n + 1)):
                return True
        return False

    kept = [(i, t) for i, t in kept if not hit(t)]
    assert 0 < len(kept) <= len(rows) - 7  # three without a language, two copies, two with the item
    path = tokenizer_path("piece_bpe_32k.model")
    encoder = pieces.Encoder(path, 0.1, 20)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in out), key=str) == sorted((i for i, _ in kept), key=str)
    got = {r.doc_id: r for r in out}
    for i, t in kept:
        if i is not None and "\n" not in t and "  " not in t and t == t.strip():
            ids = plain_ids(encoder.model, i, t, 0.1, 20)
            assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert got[i].lossless and got[i].decoded_crc32 == zlib.crc32(t.encode())


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_on_an_empty_table(spark, stage, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "some item text")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.STAGES[stage][1](spark, docs, str(tmp_path))
    assert out.count() == 0
    if stage < 4:
        assert out.columns == corpus_pipeline.COLUMNS
