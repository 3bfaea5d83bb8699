"""What earlier forms of the text operators left out."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mortise.llm import line_dedup, simhash, toxicity


def line(r, length):
    """Words without repeats of more than chance, cut to `length` characters."""
    text = ""
    while len(text) < length:
        text += "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) + " "
    return text[:length].rstrip().ljust(length, "x")


def edited(text):
    """One character changed, near the middle."""
    at = len(text) // 2
    return text[:at] + ("q" if text[at] != "q" else "z") + text[at + 1 :]


def test_lines_of_fifty_characters_with_one_edit_are_near(spark, tmp_path):
    from mortise.llm.queries import op5_line_dedup

    r = random.Random(21)
    made = [line(r, n) for n in range(56, 80) for _ in range(3)]
    rows = [(i, t) for i, t in enumerate(made)] + [(1000 + i, edited(t)) for i, t in enumerate(made)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: (x.text, x.n_dropped) for x in op5_line_dedup(spark, str(tmp_path)).collect()}
    assert (line_dedup.CHARS, line_dedup.BANDS, line_dedup.ROWS) == (5, 16, 5)
    assert line_dedup.bands_for(line_dedup.ROWS) == line_dedup.BANDS and line_dedup.bands_for(4) == 12
    assert all(got[i] == (t, 0) for i, t in enumerate(made))
    assert all(got[1000 + i] == ("", 1) for i in range(len(made)))


def near_pairs(r, n):
    """Pairs of normal lines of many lengths whose exact similarity is at least 0.8."""
    out = []
    while len(out) < n:
        a = line(r, r.choice([12, 30, 60, 120, 400]))
        b = list(a)
        for _ in range(r.randint(0, 1 + len(a) // 45)):
            b[r.randrange(len(b))] = r.choice("abc")
        a, b = line_dedup.normal(a), line_dedup.normal("".join(b))
        if a != b and len(line_dedup.Jaccard([a.encode(), b.encode()])(0, np.array([1]))):
            out.append((a, b))
    return out


def test_recall_of_the_shipped_bands_and_sketches():
    pairs = near_pairs(random.Random(22), 6000)
    keys, sketch = line_dedup.signatures([x for p in pairs for x in p])
    met = (keys[::2] == keys[1::2]).any(axis=1)
    close = np.bitwise_count(sketch[::2] ^ sketch[1::2]) <= line_dedup.most_apart(line_dedup.SKETCH)
    assert (met & close).mean() >= 0.995 and close.mean() >= 0.9995
    far, other = line_dedup.signatures([line(random.Random(i), 200) for i in range(400)])
    apart = np.bitwise_count(other[:200] ^ other[200:]) > line_dedup.most_apart(line_dedup.SKETCH)
    assert apart.mean() > 0.9 and (keys % line_dedup.BANDS == np.arange(line_dedup.BANDS)).all()


def test_normal_lines_are_those_of_each_line():
    r = random.Random(26)
    for _ in range(4000):
        t = "".join(r.choice([" ", "\n", "A", "b", "é", "\t", "\xa0", "\u2028", "Σ", "İ", "\x1c", "c"]) if r.random() < 0.4 else r.choice("Ab ") for _ in range(r.randint(0, 12)))
        assert line_dedup.normal_lines(t) == list(map(line_dedup.normal, t.split("\n"))), repr(t)


@pytest.mark.parametrize("at_once", [3, 4096])
@pytest.mark.parametrize("size", [1, 7, 1000])
def test_candidates_are_those_of_whole_buckets(monkeypatch, at_once, size):
    monkeypatch.setattr(line_dedup, "SKETCHES", at_once)
    r, bands, most = random.Random(24), 2, 3
    sketch = [r.choice([0, 0xFFFF, 0xFF00FF]) ^ (1 << r.randrange(20)) for _ in range(60)]
    rows = sorted((r.randrange(12), i, sketch[i] | (r.random() < 0.1) << line_dedup.AGAIN) for i in (r.randrange(60) for _ in range(400)))
    table = pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("bucket", "item", "sketch"), zip(*rows, strict=True), strict=True)})
    out = [x for b in line_dedup.candidates(iter(table.to_batches(max_chunksize=size)), bands, most) for x in b.to_pylist()]
    assert {x["item"] for x in out if x["low"] is None} == {i for n, i, f in rows if n % bands == 0 and (f >> line_dedup.AGAIN or sum((n, i) == x[:2] for x in rows) > 1)}
    expected = set()
    for bucket in range(12):
        items = sorted({i for n, i, _ in rows if n == bucket})
        near = [i for i in items if len(items) > at_once or any(i != j and (sketch[i] ^ sketch[j]).bit_count() <= most for j in items)]
        expected |= {(near[0], i) for i in near}
    assert {(x["low"], x["item"]) for x in out if x["low"] is not None} == expected


@pytest.mark.parametrize("in_memory", [5, 60, 1 << 21])
@pytest.mark.parametrize("size", [1, 50, 1000])
def test_packed_rows_give_the_candidates_of_sorted_rows(monkeypatch, in_memory, size):
    """Packed rows, also a bucket's beyond what is sorted in memory, meet as whole sorted rows do."""
    monkeypatch.setattr(line_dedup, "SORTED", in_memory)
    monkeypatch.setattr(line_dedup, "AT_ONCE", 16)
    monkeypatch.setattr(line_dedup, "SKETCHES", 20)
    r, bands, most = random.Random(27), 4, 3
    made = []
    for _ in range(12):
        items = np.array(sorted({r.randrange(-200, 200) for _ in range(60)}), dtype=np.int64)
        hot = items % 3 == 0
        keys = np.array([[(7 if h else int(i) // 3 * 5000) * bands + b for b in range(bands)] for i, h in zip(items, hot, strict=True)], dtype=np.int64)
        made.append((keys, items, items & 0xFF | (items % 17 == 0).astype(np.int64) << line_dedup.AGAIN))
    packed = pa.Table.from_batches([line_dedup.packed(*x) for x in made]).sort_by("parcel").combine_chunks()
    rows = sorted((k, i, s) for keys, items, sketches in made for ks, i, s in zip(keys.tolist(), items.tolist(), sketches.tolist(), strict=True) for k in ks)
    table = pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("bucket", "item", "sketch"), zip(*rows, strict=True), strict=True)})

    def found(batches):
        return {(x["low"], x["item"]) for b in line_dedup.candidates(batches, bands, most) for x in b.to_pylist()}

    assert found(line_dedup.unpacked(iter(packed.to_batches(max_chunksize=size)), bands)) == found(iter(table.to_batches()))
    assert len(packed) > 100 and list(line_dedup.unpacked(iter(packed.slice(0, 0).to_batches()), bands)) == []


def test_lines_are_hashed_once_until_they_are_packed(monkeypatch):
    monkeypatch.setattr(line_dedup, "PART", 50)
    texts = [f"line number {i // 3} of some\nshared\n" for i in range(60)]
    batches = pa.table({"text": pa.array([*texts, None])}).to_batches(max_chunksize=7)
    parts = list(line_dedup._parts(iter(batches), 1000))
    new = [x for lines, _, _ in parts for x in lines]
    assert len(new) == len(set(new)) == 21 and [last for *_, last in parts] == [False] * (len(parts) - 1) + [True]
    assert parts[-1][1] == dict.fromkeys(new, True)
    assert all(last for *_, last in line_dedup._parts(iter(batches), 1))
    monkeypatch.setattr(line_dedup, "MANY", 2)
    assert sum(last for *_, last in line_dedup._parts(iter(batches), 1000)) > 1


@pytest.mark.parametrize("more", ["", "漢字🙂", "".join(map(chr, range(0x4E00, 0x4E00 + 9000)))])
def test_exact_similarity(more):
    lines = [x for p in near_pairs(random.Random(25), 8) for x in p] + ["x", "ab" * 30, "ab" * 50] + ([more] if more else [])
    rows, grams = line_dedup.Jaccard([x.encode() for x in lines]), [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in lines]
    every = np.arange(len(lines))
    assert [rows(i, every).tolist() for i in range(len(lines))] == [[j for j, b in enumerate(grams) if len(a & b) >= 0.8 * len(a | b)] for a in grams]


def test_one_of_each_keeps_a_row_of_every_component(spark):
    r = random.Random(23)
    a, b, c, d, e = (line(r, 300) for _ in range(5))
    rows = [(None, a), (None, a), (None, b), (None, c), (5, c), (6, c), (7, d), (7, e), (8, e), (7, d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit(1) for x in ("_doc", "_none", "_body", "root")})
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, ((x.doc_id, x.text) for x in out.collect()))) == sorted(map(str, [(None, a), (None, b), (5, c), (7, d), (7, e)]))


def test_edited_copies_do_not_get_through_the_stages(spark):
    import corpus_pipeline

    r = random.Random(24)
    docs, copies = [], []
    for i, n in enumerate(range(56, 81, 2)):
        lines = [line(r, n) for _ in range(8)]
        docs.append((i, "\n".join(lines)))
        copies.append((1000 + i, "\n".join([*lines[:4], edited(lines[4]), *lines[5:]])))
    table = spark.createDataFrame([*docs, *copies], "doc_id long, text string")
    lines = corpus_pipeline.line_dedup(spark, table, "")
    assert {x.doc_id: x.text for x in lines.collect()} == dict(docs) | dict.fromkeys((i for i, _ in copies), "")
    kept = {x.doc_id for x in corpus_pipeline.simhash(spark, lines, "").collect()}
    # The emptied copies are one component.
    assert kept == {i for i, _ in docs} | {1000}


def test_the_planted_edited_copy_is_gone(spark, tmp_path):
    import corpus_pipeline
    from test_pipeline import table

    sf = table(spark, tmp_path)
    out = corpus_pipeline.line_dedup(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    kept = {x.doc_id for x in corpus_pipeline.simhash(spark, out, sf).collect()}
    assert {1000, 1003, None} <= kept and not kept & {1002} and len(kept & {1001, 1002, 1004, 1005}) == 1


def test_texts_that_share_a_passage_are_apart():
    r = random.Random(25)
    shared = line(r, 120)
    texts = [f"{shared} {line(r, 600)}" for _ in range(60)]
    assert toxicity.apart(texts) == texts
    assert toxicity.apart([texts[0], texts[0] + " more", texts[0], texts[1]]) == texts[:2]


@pytest.mark.parametrize("parts", ["1", "6"])
def test_rows_of_one_hot_id_are_cut_by_their_texts(spark, parts):
    import hashlib

    from mortise.llm import minhash, neighbours

    r = random.Random(27)
    rows = [(None, line(r, r.randint(0, 90))) for _ in range(150)] + [(7, r.choice("abcdé🙂") * r.randint(0, 5)) for _ in range(150)] + [(i, line(r, 40)) for i in range(-60, 60)] + [(None, "same")] * 30
    r.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        texts = docs.select("text", F.coalesce("doc_id", F.lit(neighbours.NO_ID)).alias("_key"), F.substring("text", 1, neighbours.HEAD).alias("_head"))
        cut = neighbours.cut_ranges(texts, neighbours.RANGES * int(parts))
        got = sorted((x.doc_id is None, x.doc_id or 0, x.n_chars, x.edited_sha256) for x in minhash.edit_fingerprints(docs).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(cut.heads[neighbours.NO_ID]) > 2 and len(cut.heads[7]) > 2
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
    expected = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        expected.append((i is None, i or 0, len(t), hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest()))
    assert got == sorted(expected)


def test_sketches_are_those_of_a_plain_version():
    from mortise.llm import minhash

    def plain(hashes, bins, bits):
        least = {}
        for h in map(int, hashes):
            at = h >> 64 - (bins.bit_length() - 1)
            least[at] = min(least.get(at, h), h)
        out = 0
        for i in range(bins):
            # An empty bin probes the others in an order of its own until one is filled.
            probes = [i] if i in least else sorted(range(bins), key=lambda j: (minhash.donor_order(bins)[i, j], j))
            low = least[next(j for j in probes if j in least)] & (1 << bits) - 1
            for b in range(bits):
                out = out << 1 | low >> b & 1
        return out.to_bytes(bins * bits // 8, "big")

    r = random.Random(28)
    for n in (1, 2, 5, 40, 700):
        h = minhash.shingle_hashes(" ".join(str(r.randrange(10**6)) for _ in range(n + 4)))
        assert len(h) == n and minhash.sketch(h) == plain(h, minhash.BINS, minhash.BITS)


def test_repeated_rows_are_packed_in_many_groups(spark):
    from mortise.llm import packing
    from mortise.llm.queries import BYTES

    docs = spark.createDataFrame([(1, "one text")] * 400 + [(None, None)] * 200, "doc_id long, text string")
    rows = packing.pack(docs.coalesce(1), BYTES, group_docs=20).collect()
    groups = {}
    for x in rows:
        groups[x.sequence_id >> 32] = groups.get(x.sequence_id >> 32, 0) + 1
    assert len(rows) == 600 and len(groups) > 20 and max(groups.values()) < 60
    assert len({(x.sequence_id, x.offset) for x in rows}) == 600


def test_learning_takes_one_bounded_text_of_an_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda toxic, ordinary: seen.append((list(toxic), list(ordinary))))
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "x" * 50), (3, "c"), (3, "c"), (None, "d"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0), (None, 1), (9, 1)], "doc_id long, toxic int")
    learned = {r.doc_id for r in docs.where(toxicity.learns()).select("doc_id").distinct().collect()}
    toxicity.fit(docs, labels, text_bytes=20)
    toxic, ordinary = seen[0]
    assert toxic == (["a"] if 1 in learned else []) and ordinary == [t for i, t in ((3, "c"), (4, "")) if i in learned] and len(learned & {1, 3, 4}) >= 2


def test_shards_prune_files(spark, tmp_path):
    from mortise.llm import hilbert

    docs = spark.range(4096).selectExpr("(id * 7919) % 4096 as doc_id", "repeat('x', cast((id * 131) % 500 as int)) as text", "concat('s', id % 8) as source", "concat('l', (id div 8) % 4) as lang")
    hilbert.write_shards(docs, str(tmp_path / "out"), count=64)
    ends = spark.read.parquet(str(tmp_path / "out")).groupBy("shard").agg(*(f(c).alias(f"{n}_{c}") for c in ("source", "lang", "doc_id") for n, f in (("low", F.min), ("high", F.max)))).collect()
    read = {c: np.mean([sum(e[f"low_{c}"] <= v <= e[f"high_{c}"] for e in ends) / len(ends) for v in values]) for c, values in (("source", [f"s{i}" for i in range(8)]), ("lang", [f"l{i}" for i in range(4)]), ("doc_id", range(0, 4096, 97)))}
    assert len(ends) == 64 and max(read.values()) < 0.7


def test_unlike_lines_of_a_bucket_are_not_compared_one_by_one():
    """Marks keep lines that met by chance from the exact check, whose work else grows with the square of a bucket, and no link is lost."""
    r = random.Random(31)
    words = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 7))) for _ in range(400)]
    lines = [" ".join(r.choice(words) for _ in range(60)) for _ in range(150)] + [x for p in near_pairs(r, 20) for x in p]
    rows, grams = line_dedup.Jaccard([x.encode() for x in lines]), [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in lines]
    read = []

    class Sets(list):
        def __getitem__(self, i):
            read.append(i)
            return super().__getitem__(i)

    rows.sets = Sets(rows.sets)
    every = np.arange(len(lines))
    assert [rows(i, every).tolist() for i in range(len(lines))] == [[j for j, b in enumerate(grams) if len(a & b) >= 0.8 * len(a | b)] for a in grams]
    assert len(read) < 5 * len(lines)
    apart = [[int(np.bitwise_count(rows.marks[i] ^ rows.marks[j]).sum()) for j in every] for i in every]
    assert all(apart[i][j] <= len(grams[i] ^ grams[j]) for i in every for j in every)


def test_packed_rows_hold_whole_sketches():
    lines = [line(random.Random(i), 80) for i in range(500)]
    keys, sketches = line_dedup.signatures(lines)
    items = line_dedup.line_keys(lines)
    sketches |= (items % 3 == 0).astype(np.int64) << line_dedup.AGAIN
    got, out = line_dedup.packed(keys, items, sketches), set()
    for number, blob in zip(got.column("parcel").to_pylist(), got.column("rows").to_pylist(), strict=True):
        out |= {tuple(x) for x in line_dedup.read_back(np.frombuffer(blob, dtype=line_dedup.ROW), number, line_dedup.BANDS).tolist()}
    assert out == {(k, i, s) for ks, i, s in zip(keys.tolist(), items.tolist(), sketches.tolist(), strict=True) for k in ks}
    assert line_dedup.most_apart(line_dedup.SKETCH) < 0.3 * line_dedup.SKETCH
