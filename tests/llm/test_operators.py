"""The training-data operators against brute force on small, awkward tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomix.llm import decontaminate, embeddings, jaccard, language, line_dedup, pieces, quality, sharding, substring, token_files
from loomix.llm.registry import tokenizer_path

WHITE = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(text):
    return (text or "").encode().split()


def texts():
    rng = random.Random(3)
    base = [" ".join(rng.choice(["the", "of", "Tion", "über", "x", "rare%d" % rng.randint(0, 300)]) for _ in range(rng.randint(1, 160))) for _ in range(40)]
    rows = [None, "", " \n\t ", "one", "a b", "A b", "  nbsp em", "word " * 3000]
    rows += base + base[:10]
    for b in base[:20]:
        w = b.split(" ")
        w[len(w) // 2] = "changed"
        rows.append(" ".join(w))
    line = "A line that is shared by many documents of this table"
    rows += [f"start {i}\n  {line.upper() if i % 2 else line}\t\nend" for i in range(8)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], "s", 1, "clash") for i, t in enumerate(texts())]
    rows.append((None, rows[10][1], "en", "s", 1, "clash"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, id string").repartition(5).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def known(docs):
    return sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None)


@pytest.mark.parametrize("window", [3, 12, 50])
def test_substring(docs, empty, window):
    rows = known(docs)
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    want = {}
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(window)}
        want[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring.dedup_substrings(docs, window=window).collect()}
    assert got.pop(None)[1] == 0
    assert got == want
    assert substring.dedup_substrings(empty, window=window).count() == 0


def test_substring_in_one_task(docs):
    want = sorted(map(str, substring.dedup_substrings(docs, window=12).collect()))
    assert sorted(map(str, substring.dedup_substrings(docs.repartition(1), window=12).collect())) == want


def alnum(text):
    out, word = [], ""
    for c in lower(text or "") + " ":
        if c.isascii() and not c.isalnum():
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


@pytest.mark.parametrize("block_bytes", [4 << 20, 200])
def test_decontaminate(spark, docs, empty, block_bytes):
    sample = [t for _, t in known(docs) if t]
    items = [(1, sample[20][:90]), (2, "über x"), (3, None), (4, ""), (5, "nowhere at all to be found in any text of this table, surely"), (None, sample[9]), (6, sample[12]), (6, sample[12])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in known(docs):
        w, hit, ids = alnum(t), set(), set()
        for item, x in items:
            v = alnum(x)
            n = min(10, len(v))
            if item is None or not n:
                continue
            for k in range(len(v) - n + 1):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[k : k + n]:
                        hit |= set(range(p, p + n))
                        ids.add(str(item))
        want[i] = (len(w), hit, sorted(ids))
    found = decontaminate.decontaminate(docs, bench, ["doc_id"], block_bytes=block_bytes).collect()
    got = {r.doc_id: (r.n_words, {p for a, b in zip(r.spans[::2], r.spans[1::2]) for p in range(a, b)}, list(r["items"])) for r in found}
    got.pop(None)
    assert got == want
    assert decontaminate.decontaminate(empty, bench, ["doc_id"]).count() == 0
    assert decontaminate.decontaminate(docs, bench.where("false"), ["doc_id"]).where("size(items) > 0").count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 16))
    rows = [(i, (base[i % 60] + rng.standard_normal(16) * 0.02 * (i % 9)).tolist(), i % 60 % 3) for i in range(300)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, rows[0][1], 1), (303, None, 0), (304, [0.0] * 16, 0), (305, [float("nan")] * 16, 0), (306, [None] * 16, 0), (307, rows[0][1], None), (308, [1.0], 0), (309, [2.0], 0), (310, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    links = {i: set() for i, _, _ in rows}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, l in rows if v and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {i: l for i, _, l in rows}
    for i in unit:
        for j in unit:
            if i < j and label[i] == label[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                links[i].add(j)
                links[j].add(i)
    want = {i: (len(x), min(reach(i, links)), min(reach(i, links)) == i) for i, x in links.items()}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, 0.93, block=32).collect()}
    assert got == want
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def reach(i, links):
    seen, todo = {i}, [i]
    while todo:
        for j in links[todo.pop()] - seen:
            seen.add(j)
            todo.append(j)
    return seen


def test_pieces_equal_the_library_without_dropout(docs):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = pieces.encode(docs, path, dropout=0).collect()
    text = dict(known(docs))
    assert {r.doc_id: r.ids for r in rows if r.doc_id is not None} == {i: sp.encode(t or "") for i, t in text.items()}


def test_pieces_round_trip_with_dropout(spark, docs, empty):
    path = tokenizer_path("piece_bpe_32k.model")
    odd = spark.createDataFrame([(1000, "▁ literal ▁▁ sign \x00 é🎉  two"), (1001, "a" * 500), (1002, "  ")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(odd)
    one = {r.doc_id: r.ids for r in pieces.encode(rows, path, dropout=0.3, seed=1).collect()}
    two = {r.doc_id: r.ids for r in pieces.encode(rows, path, dropout=0.3, seed=2).collect()}
    assert one != two
    back = pieces.decode(pieces.encode(rows, path, dropout=0.3, seed=1), path, ["doc_id"]).collect()
    text = {r.doc_id: r.text or "" for r in rows.collect()}
    assert {r.doc_id: r.text for r in back} == text
    assert all(r.lossless and r.n_tokens == len(one[r.doc_id]) for r in pieces.round_trip(rows, path, dropout=0.3, seed=1, variants=4).collect())
    assert pieces.round_trip(empty, path).count() == 0


def test_pieces_dropout_varies_by_document_and_place(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    rows = spark.createDataFrame([(i, " ".join(["international"] * 300)) for i in (0, 1, 2, 3, None)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in pieces.encode(rows, path, dropout=0.3, seed=1).collect()}
    assert len({tuple(x) for x in got.values()}) == 5  # exact copies differ
    model = pieces.cached(path, 0.3, 1).model
    ways, word = set(), []
    for i in sum(got.values(), []):
        if word and model.bytes_of[i][:1] == b" ":
            ways.add(tuple(word))
            word = []
        word.append(i)
    assert len(ways) > 20
    again = {r.doc_id: r.ids for r in pieces.encode(rows.repartition(3), path, dropout=0.3, seed=1).collect()}
    assert again == got


def test_sharding(spark, docs, empty):
    rows = sharding.assign_shards(docs, 3000).collect()
    assert len(rows) == docs.count()
    size, many = {}, {}
    for r in rows:
        size[r.shard] = size.get(r.shard, 0) + r.n_bytes
        many[r.shard] = many.get(r.shard, 0) + 1
    for r in rows:
        assert size[r.shard] == r.shard_bytes and many[r.shard] == r.shard_docs
        assert r.shard_bytes <= 3000 or r.shard_docs == 1 and r.oversized
        if r.depth:  # only a bucket that is too large was split
            parent = [k for k in size if k.startswith(r.shard[:-1])]
            assert sum(size[k] for k in parent) > 3000
    assert sharding.assign_shards(empty, 3000).count() == 0
    same = spark.range(500).select(F.lit(1).alias("doc_id"), F.lit("x" * 50).alias("text"))
    assert all(r.shard_bytes <= 3000 for r in sharding.assign_shards(same, 3000).collect())


def test_jaccard(docs, empty):
    for shingle, t in ((4, 0.85), (5, 0.8), (2, 0.5)):
        rows = known(docs)
        sets = {}
        for i, text in rows:
            w = lower(text or "").encode().split()
            sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
        links = {i: {j for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])} for i in sets}
        want = {i: (len(sets[i]), min(reach(i, links))) for i in sets}
        for frequent in (2, 64):
            got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs, str(t), shingle, frequent=frequent).where("doc_id is not null").collect()}
            assert got == want, (shingle, frequent)
    assert jaccard.similar_groups(empty).count() == 0


def test_jaccard_heavy_group(spark):
    """Many near copies whose shingles are all frequent: only combinations can find their links."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(120), rng.randint(0, 5)):
            w[k] = f"x{rng.randint(0, 3)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(117)} for i, t in rows}
    links = {i: {j for j in sets if j != i and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])} for i in sets}
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(df, "0.85", 4, frequent=4).collect()}
    assert got == {i: min(reach(i, links)) for i in sets}


def test_line_dedup_and_its_reversal(spark, docs, empty):
    def brute(rows):
        keys = {}
        key = lambda x: lower(x.strip(WHITE))
        for i, t in rows:
            for x in (t or "").split("\n"):
                if len(key(x)) >= 40:
                    keys.setdefault(key(x), set()).add(i)
        out = {}
        for i, t in rows:
            lines = (t or "").split("\n")
            kept = [x for x in lines if not (len(key(x)) >= 40 and len(keys[key(x)]) >= 5 and max(keys[key(x)]) != i)]
            out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
        return out

    rows = known(docs)
    index = line_dedup.LineIndex(spark, shards=4).insert(docs)
    see = lambda df: {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in df.where("doc_id is not null").collect()}
    assert see(index.dedup(docs)) == brute(rows)
    assert see(line_dedup.dedup_lines(docs)) == brute(rows)
    last = max(i for i, _ in rows)
    index.delete(docs.where(f"doc_id > {last - 2}"))
    rest = docs.where(f"doc_id <= {last - 2}")
    assert see(index.dedup(rest)) == brute([x for x in rows if x[0] <= last - 2])
    index.delete(docs.where(f"doc_id between {last - 5} and {last - 2}"))
    rest = docs.where(f"doc_id < {last - 5}")
    assert see(index.dedup(rest)) == brute([x for x in rows if x[0] < last - 5])
    index.insert(docs.where(f"doc_id >= {last - 5}"))
    assert see(index.dedup(docs)) == brute(rows)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_cuckoo_filter():
    h = np.random.default_rng(0).integers(0, 2**63, 4000).astype(np.uint64)
    f = line_dedup.CuckooFilter.empty(4000)
    assert f.insert(h) and f.contains(h).all()
    f.delete(h[:2000])
    assert f.contains(h[2000:]).all() and f.contains(h[:2000]).mean() < 0.01


def test_language(spark, docs, empty):
    en, de, fr = "the of and with that this", "der und nicht mit eine schön", "le avec être même pour vous"
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(x.split()) for _ in range(20)), l) for i in range(400) for x, l in [((en, "en"), (de, "de"), (fr, "fr"))[i % 3]]]
    rows += [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "", None), (1003, "the and", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert len(got) == len(rows)
    for i in (1000, 1001, 1002):
        assert got[i].lang_pred == "und" and got[i].score == 0
    test = [(i, l) for i, _, l in rows[:400] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i, _ in test)
    assert sum(got[i].lang_pred == l for i, l in test) / len(test) > 0.97
    assert language.identify(empty).count() == 0
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality(spark, empty):
    rng = random.Random(4)
    good = lambda: ".\n".join(" ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(12)).capitalize() for _ in range(4))
    bad = lambda: "\n".join(" | ".join(f"{rng.randint(0, 999)}$$" for _ in range(9)) for _ in range(4))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)] + [(1000, None), (1001, ""), (1002, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(df, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    test = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].predicted == int(i % 3 > 0) for i in test) / len(test) > 0.97
    assert quality.classify(empty, labels).count() == 0
    assert {r.score for r in quality.classify(df, labels.where("false")).collect()} == {0.5}


def test_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(5)
    unary, trans = rng.standard_normal(9), rng.standard_normal((2, 2))
    first = np.array([0, 4, 5, 9])
    good, pairs, z = quality.marginals(unary, first, trans)
    counts = np.zeros((2, 2))
    for k, (a, b) in enumerate(zip(first, first[1:])):
        weight = {}
        for y in itertools.product((0, 1), repeat=b - a):
            weight[y] = np.exp(sum(u * v for u, v in zip(unary[a:b], y)) + sum(trans[p, q] for p, q in zip(y, y[1:])))
        total = sum(weight.values())
        assert np.isclose(np.log(total), z[k])
        assert np.allclose(good[a:b], [sum(w for y, w in weight.items() if y[t]) / total for t in range(b - a)])
        for y, w in weight.items():
            for p, q in zip(y, y[1:]):
                counts[p, q] += w / total
    assert np.allclose(counts, pairs)


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_token_files(docs, empty, planes):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = token_files.token_files(docs, path, planes=planes, block=64).collect()
    text = dict(known(docs))
    start = len(tokenizer.encode(next(r.text for r in docs.where("doc_id is null").collect()), add_special_tokens=False).ids) + 1  # the null id comes first
    got = {r.doc_id: r for r in rows}
    for i in sorted(text):
        ids = [*tokenizer.encode(text[i] or "", add_special_tokens=False).ids, 0]
        assert got[i].ids == ids and (got[i].start, got[i].n_tokens) == (start, len(ids))
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_files.token_files(empty, path).count() == 0


def test_planes_round_trip():
    ids = np.random.default_rng(1).integers(0, 2**32, 1000).astype(np.uint32)
    for planes in ("bit", "byte"):
        for block in (8, 64, 4096):
            assert (token_files.restore_planes(token_files.shuffle_planes(ids, block, planes), len(ids), block, planes) == ids).all()


def test_token_files_with_added_tokens(spark, tmp_path):
    from tokenizers import AddedToken, Tokenizer

    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}  x", f"a  {end}\n\n b's{end}'s {end} 's\tü{end}ü", "<|endof", "text|>", "'", f"s{end[:-1]} {end} {end}{end[1:]}\n{end}\n", "no such token"]
    path = tokenizer_path("byte_bpe_50k.json")
    other = str(tmp_path / "other.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_tokens([AddedToken("such", single_word=True), AddedToken("<|x|>", lstrip=True, rstrip=True)])
    tokenizer.save(other)
    texts += ["nosuch such", " <|x|> \n a <|x|>b "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for p in (path, other):
        start, tokenizer = 0, Tokenizer.from_file(p)
        got = {r.doc_id: r for r in token_files.token_files(df, p).collect()}
        for i, text in enumerate(texts):
            ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
            assert (got[i].ids, got[i].start, got[i].n_tokens) == (ids, start, len(ids)), text
            assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            start += len(ids)


def test_jaccard_stage_keeps_null_ids_and_decides_rows(spark):
    import corpus_pipeline

    base = [f"w{k}" for k in range(60)]
    near = " ".join([*base[:-1], "other"])
    text, lone, third = " ".join(base), " ".join(f"v{k}" for k in range(30)), " ".join(f"u{k}" for k in range(30))
    unique = [(None, text), (None, text), (None, None), (1, text), (2, near), (3, lone), (4, ""), (5, None)]
    repeated = [*unique, (2, third), (2, third), (3, lone), (4, ""), (0, lone), (6, third)]
    kept = {0: [(None, text), (None, text), (None, None), (1, text), (3, lone), (4, ""), (5, None)]}
    # 2's near copy of 1 goes although 2's other row is a group's first; of its equal rows one stays.
    kept[1] = [(None, text), (None, text), (None, None), (1, text), (0, lone), (2, third), (4, ""), (4, ""), (5, None)]
    order = lambda rows: sorted(rows, key=repr)
    for rows, want in ((unique, kept[0]), (repeated, kept[1])):
        df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        assert order((r.doc_id, r.text) for r in corpus_pipeline.jaccard_stage(spark, df, "").collect()) == order(want)
        assert corpus_pipeline.jaccard_stage(spark, df.where("false"), "").count() == 0


def test_language_learns_every_label(spark):
    own = {f"l{k:02d}": [f"{a}{b}{a}" for b in "aeiou"] for k, a in enumerate(["b", "c", "d", "f", "g", "h", "k", "l", "m", "n", "p", "r"])}
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(w) for _ in range(20)), l) for k, (l, w) in enumerate(own.items()) for i in range(100 * k, 100 * k + 8 + 5 * k)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, sample=400)  # room for eight languages of 50 rows
    assert sorted(sum(model.families.values(), [])) == sorted(own)
    got = {r.doc_id: r.lang_pred for r in language.predict(df, model, ["doc_id"]).collect()}
    assert sum(got[i] == l for i, _, l in rows) / len(rows) > 0.97
